"""The engine's registered queries over the derived process events, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import anomalies as A
from .functions import scoring as S
from .functions import text as X
from .operators import alerts as Q
from .operators import chains, episodes, lineage
from .operators.detect import detect, matched_rules
from .operators.store import Store
from .plans.compile import basename, contains_all, contains_any, matches, prepare, whitelisted
from .plans.derived import DUCKDB, process_events
from .rules.builtin import CHAINS, RULES
from .rules.model import Rule, rule_by_id
from .sinks import export
from .storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ------------------------------------------------------------- SQL pieces


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BASE = r"CASE WHEN platform = 'windows' THEN lower(regexp_extract(trim(coalesce({c}, '')), '[^/\\]*$')) ELSE regexp_extract(trim(coalesce({c}, '')), '[^/\\]*$') END"
_PREP = f"""pe AS ({DUCKDB}), prep AS (
  SELECT *, coalesce(command_line, '') AS cmd, lower(coalesce(command_line, '')) AS cmd_l, {_BASE.format(c="process_name")} AS proc, {_BASE.format(c="parent_process_name")} AS parent,
         lower(coalesce("user", '')) AS user_l, lower(coalesce(working_directory, '')) AS cwd_l FROM pe
)"""
_TOKENS = "list_filter(regexp_extract_all(cmd, '[A-Za-z0-9+/=]{80,}'), lambda t: list_aggregate(string_split(t, ''), 'entropy') >= 4.5)"


def _any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(p)})" for p in parts) + ")"


_FLAGS = {
    "encoded_payload": _any("cmd_l", A.ENCODED_PAYLOAD),
    "download_cradle": _any("cmd_l", A.DOWNLOAD_CRADLE),
    "obfuscation": _any("cmd_l", A.OBFUSCATION) + r""" OR regexp_matches(cmd, '(?i)`[a-z]') OR regexp_matches(cmd, '\^[a-zA-Z]{2,}') OR regexp_matches(cmd, '(?i)''[a-z]''\s*\+\s*''[a-z]''')""",
    "unusual_path": _any("cmd_l", A.UNUSUAL_PATH),
    "suspicious_flags": _any("cmd_l", A.SUSPICIOUS_FLAGS),
    "high_entropy_argument": f"length(cmd) >= 300 OR len({_TOKENS}) > 0",
}


def _criteria_sql(rule: Rule) -> list[str]:
    d, out = rule.detection, []
    for c in rule.criteria:
        if c == "process_name":
            out.append(f"proc = {_q(basename(d[c], rule.platform))}")
        elif c == "command_contains":
            out += [f"contains(cmd_l, {_q(p.lower())})" for p in d[c]]
        elif c == "command_contains_any":
            out.append(_any("cmd_l", [p.lower() for p in d[c]]))
        elif c == "command_regex":
            out.append(f"regexp_matches(cmd, {_q(d[c])}, 'i')")
    return out


def _white_sql(rule: Rule) -> str:
    w, out = rule.whitelist, []
    if w.get("users"):
        out.append("user_l IN (" + ", ".join(_q(u.lower()) for u in w["users"]) + ")")
    if w.get("parent_processes"):
        out.append("parent IN (" + ", ".join(_q(basename(p, rule.platform)) for p in w["parent_processes"]) + ")")
    if w.get("paths"):
        out.append(_any("cwd_l", [p.lower() for p in w["paths"]]))
    return "(" + " OR ".join(out) + ")" if out else "false"


def _rule_sql(rule: Rule) -> str:
    return " AND ".join([f"platform = {_q(rule.platform)}", *_criteria_sql(rule), f"NOT {_white_sql(rule)}"])


_HITS = " UNION ALL ".join(
    f"SELECT *, {_q(r.id)} AS rule_id, {_q(r.name)} AS rule_name, {_q(r.severity)} AS severity, {S.SEVERITY[r.severity]} AS sub, {S.CRITERIA[min(4, len(r.criteria))]} AS crit, {_q(','.join(r.mitre_attack))} AS mitre FROM prep WHERE {_rule_sql(r)}" for r in RULES
)
_ALERTS = f"""{_PREP}, hits AS ({_HITS}), flagged AS (
  SELECT *, {", ".join(f"({sql}) AS {n}" for n, sql in _FLAGS.items())} FROM hits
), conf AS (
  SELECT *, least(100, 35 + crit + CASE WHEN upper("user") IN ('SYSTEM', 'NT AUTHORITY\\SYSTEM', 'ROOT') AND (encoded_payload OR download_cradle) THEN 15 ELSE 0 END
    + least(25, {" + ".join(f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in A.WEIGHTS.items())})) AS confidence FROM flagged
), scored AS (
  SELECT *, CAST(floor((sub * (100 + 3 * confidence) * 3 + 400) / 800.0) AS INTEGER) AS score FROM conf
), alerts AS (
  SELECT *, CASE WHEN score >= 120 THEN 'critical' WHEN score >= 90 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS risk_band FROM scored
)"""
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
#: A fixed clock inside the derived time line.
_NOW = 1704067200000000 + 20_000_000_000


def _now():
    return F.timestamp_micros(F.lit(_NOW))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(process_events(spark, sf_dir), RULES, explain=False)


def _micros(c: str):
    return F.unix_micros(c).alias("us")


# ------------------------------------------------------------- predicates


def _predicate_query(name: str, column, sql: str) -> None:
    @query(name, f"WITH {_PREP} SELECT event_id, platform, command_line FROM prep WHERE {sql}")
    def run(spark, sf_dir):
        return prepare(process_events(spark, sf_dir)).where(column()).select("event_id", "platform", "command_line")


_predicate_query("detect_process_name", lambda: F.col("_proc") == "powershell.exe", "proc = 'powershell.exe'")
_predicate_query("detect_contains_all", lambda: contains_all(["-urlcache", "HTTP"]), "contains(cmd_l, '-urlcache') AND contains(cmd_l, 'http')")
_predicate_query("detect_contains_any", lambda: contains_any(["LaunchAgents", "LaunchDaemons", "/etc/systemd"]), _any("cmd_l", ["launchagents", "launchdaemons", "/etc/systemd"]))
_predicate_query("detect_regex", lambda: matches("_cmd", rule_by_id(RULES, "LNX-001").detection["command_regex"]), f"regexp_matches(cmd, {_q(rule_by_id(RULES, 'LNX-001').detection['command_regex'])}, 'i')")
_predicate_query("detect_parent", lambda: (F.col("_parent") == "explorer.exe") & F.col("parent_process_name").isNotNull(), "parent = 'explorer.exe'")
_predicate_query("detect_user_pattern", lambda: matches("_user", "^(admin|system)$"), """regexp_matches("user", '^(admin|system)$', 'i')""")


def _whitelist_query(name: str, kind: str, ids: list[str]) -> None:
    part = [Rule(r.id, r.name, r.platform, r.severity, r.detection, whitelist={kind: r.whitelist[kind]}) for r in (rule_by_id(RULES, i) for i in ids)]
    sql = " UNION ALL ".join(f"SELECT event_id, {_q(r.id)} AS rule_id, {_white_sql(r)} AS excused FROM prep WHERE " + " AND ".join([f"platform = {_q(r.platform)}", *_criteria_sql(r)]) for r in part)

    @query(name, f"WITH {_PREP} {sql}")
    def run(spark, sf_dir):
        from .plans.compile import criteria

        ready, out = prepare(process_events(spark, sf_dir)), None
        for r in part:
            found = ready.where(F.col("platform") == r.platform)
            for c in criteria(r):
                found = found.where(c)
            found = found.select("event_id", F.lit(r.id).alias("rule_id"), whitelisted(r).alias("excused"))
            out = found if out is None else out.unionByName(found)
        return out


_whitelist_query("whitelist_user", "users", ["LNX-003", "LNX-008", "WIN-001"])
_whitelist_query("whitelist_parent", "parent_processes", ["WIN-006", "MAC-003", "LNX-008"])
_whitelist_query("whitelist_path", "paths", ["MAC-002", "MAC-003", "LNX-001"])

# ------------------------------------------------------------- detection and scores


@query("detect_multi_rule", f"WITH {_PREP}, hits AS ({_HITS}) SELECT event_id, rule_id, severity FROM hits")
def detect_multi_rule(spark, sf_dir):
    return matched_rules(process_events(spark, sf_dir), RULES).select("event_id", "rule_id", "severity")


@query("anomaly_flags", f"WITH {_PREP} SELECT event_id, {', '.join(f'({sql}) AS {n}' for n, sql in _FLAGS.items())} FROM prep")
def anomaly_flags(spark, sf_dir):
    return process_events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in A.flags(F.col("command_line")).items()])


@query("anomaly_weight", f"WITH {_PREP}, f AS (SELECT event_id, {', '.join(f'({sql}) AS {n}' for n, sql in _FLAGS.items())} FROM prep) SELECT event_id, CAST(least(25, {' + '.join(f'CASE WHEN {n} THEN {w} ELSE 0 END' for n, w in A.WEIGHTS.items())}) AS INTEGER) AS delta FROM f")
def anomaly_weight(spark, sf_dir):
    return process_events(spark, sf_dir).select("event_id", A.weight(A.anomalies(F.col("command_line"))).cast("int").alias("delta"))


@query("entropy_tokens", f"WITH {_PREP}, t AS (SELECT event_id, unnest(regexp_extract_all(cmd, '[A-Za-z0-9+/=]{{8,}}')) AS token FROM prep) SELECT event_id, token, round(list_aggregate(string_split(token, ''), 'entropy'), 6) AS entropy FROM t")
def entropy_tokens(spark, sf_dir):
    tokens = F.explode(F.regexp_extract_all("command_line", F.lit("[A-Za-z0-9+/=]{8,}"), F.lit(0))).alias("token")
    return process_events(spark, sf_dir).select("event_id", tokens).select("event_id", "token", F.round(X.entropy(F.col("token")), 6).alias("entropy"))


@query("score_alerts", f"WITH {_ALERTS} SELECT event_id, rule_id, CAST(sub AS INTEGER) AS severity_subscore, CAST(confidence AS INTEGER) AS confidence_subscore, score, risk_band FROM alerts")
def score_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select("event_id", "rule_id", "severity_subscore", "confidence_subscore", "score", "risk_band")


@query("risk_bands", f"WITH {_ALERTS} SELECT risk_band, count(*) AS n, CAST(min(score) AS INTEGER) AS least, CAST(max(score) AS INTEGER) AS most FROM alerts GROUP BY risk_band")
def risk_bands(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("score_breakdown", f"WITH {_ALERTS} SELECT event_id, rule_id, round(0.25 + 0.75 * confidence / 100.0, 6) AS multiplier, CAST(crit AS INTEGER) AS criteria_delta FROM alerts")
def score_breakdown(spark, sf_dir):
    b = F.col("score_breakdown")
    return detect(process_events(spark, sf_dir), RULES).select("event_id", "rule_id", b["combination"]["confidence_multiplier"].alias("multiplier"), b["confidence"]["factors"][0]["delta"].alias("criteria_delta"))


@query("interpret_scores", f"WITH {_ALERTS} SELECT event_id, rule_id, CASE {" ".join(f"WHEN score >= {least} THEN {_q(text)}" for least, text in S.READINGS)} ELSE 'Informational: Low priority' END AS reading FROM alerts")
def interpret_scores(spark, sf_dir):
    return _alerts(spark, sf_dir).select("event_id", "rule_id", S.interpret(F.col("score")).alias("reading"))


# ------------------------------------------------------------- alert analytics

for _column in ("severity", "platform", "rule_id"):

    @query(f"alerts_by_{_column}", f"WITH {_ALERTS} SELECT {_column}, count(*) AS n FROM alerts GROUP BY {_column}")
    def _count(spark, sf_dir, column=_column):
        return Q.count_by(_alerts(spark, sf_dir), column)


@query("score_histogram", f"WITH {_ALERTS} SELECT " + ", ".join(f"CAST(coalesce(sum(CASE WHEN score BETWEEN {a} AND {b} THEN 1 ELSE 0 END), 0) AS BIGINT) AS score_{a}_{b}" for _, a, b in Q.BANDS) + " FROM alerts")
def score_histogram(spark, sf_dir):
    return Q.score_histogram(_alerts(spark, sf_dir))


@query("high_score_alerts", f"WITH {_ALERTS} SELECT event_id, rule_id, score, us FROM alerts WHERE score >= 100")
def high_score_alerts(spark, sf_dir):
    return Q.high_scores(_alerts(spark, sf_dir), 100).select("event_id", "rule_id", "score", _micros("ts"))


@query("alerts_time_range_topk", f"WITH {_ALERTS} SELECT event_id, rule_id, us FROM alerts WHERE us BETWEEN {_NOW - 10_000_000_000} AND {_NOW} ORDER BY us DESC, event_id DESC, rule_id DESC LIMIT 100")
def alerts_time_range_topk(spark, sf_dir):
    rows = Q.in_time(_alerts(spark, sf_dir), F.timestamp_micros(F.lit(_NOW - 10_000_000_000)), _now())
    return rows.orderBy(F.desc("ts"), F.desc("event_id"), F.desc("rule_id")).limit(100).select("event_id", "rule_id", _micros("ts"))


@query("alerts_last_24h", f"WITH {_ALERTS} SELECT count(*) AS n FROM alerts WHERE us >= {_NOW - 86_400_000_000}")
def alerts_last_24h(spark, sf_dir):
    return Q.recent_count(_alerts(spark, sf_dir), _now())


@query("alert_stats", f"WITH {_ALERTS} SELECT count(*) AS total, " + ", ".join(f"CAST(sum(CASE WHEN score BETWEEN {a} AND {b} THEN 1 ELSE 0 END) AS BIGINT) AS score_{a}_{b}" for _, a, b in Q.BANDS) + f", count(*) FILTER (us >= {_NOW - 86_400_000_000}) AS last_24h FROM alerts")
def alert_stats(spark, sf_dir):
    return Q.alert_stats(_alerts(spark, sf_dir), _now())


@query("summary_top_rules", f"WITH {_ALERTS} SELECT rule_id, count(*) AS n FROM alerts GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5")
def summary_top_rules(spark, sf_dir):
    return Q.top_rules(_alerts(spark, sf_dir))


@query("summary_severity_share", f"WITH {_ALERTS} SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM alerts GROUP BY severity")
def summary_severity_share(spark, sf_dir):
    return Q.share_by(_alerts(spark, sf_dir), "severity")


@query("summary_scores", f"WITH {_ALERTS} SELECT count(*) AS n, avg(score) AS avg_score, max(score) AS max_score, min(score) AS min_score FROM alerts")
def summary_scores(spark, sf_dir):
    return Q.score_summary(_alerts(spark, sf_dir))


@query("event_stats", f"WITH {_PREP} SELECT count(*) AS total, min(us) AS earliest, max(us) AS latest, count(DISTINCT process_name) AS unique_processes, count(DISTINCT \"user\") AS unique_users FROM prep")
def event_stats(spark, sf_dir):
    return Q.event_stats(process_events(spark, sf_dir)).select("total", F.unix_micros("earliest").alias("earliest"), F.unix_micros("latest").alias("latest"), "unique_processes", "unique_users")


_RULE_COUNTS = ", ".join(f"({_q(p)}, {_q(s)}, CAST({n} AS BIGINT))" for p in ("linux", "macos", "windows") for s in ("critical", "high", "low", "medium") if (n := sum(r.platform == p and r.severity == s for r in RULES)))


@query("rule_stats", f"WITH {_ALERTS}, t AS (SELECT * FROM (VALUES {_RULE_COUNTS}) t(rule_platform, severity, n)), f AS (SELECT platform AS rule_platform, severity, count(*) AS found FROM alerts GROUP BY ALL) SELECT rule_platform, severity, n, coalesce(found, 0) AS alerts FROM t LEFT JOIN f USING (rule_platform, severity)")
def rule_stats(spark, sf_dir):
    """Rules of each platform and severity, and the alerts that they raise."""
    from .operators.detect import rules_table

    found = _alerts(spark, sf_dir).groupBy(F.col("platform").alias("rule_platform"), "severity").agg(F.count(F.lit(1)).alias("found"))
    rules = rules_table(spark, RULES).groupBy("rule_platform", "severity").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(found, ["rule_platform", "severity"], "left").select("rule_platform", "severity", "n", F.coalesce("found", F.lit(0)).alias("alerts"))


@query("alert_page", f"WITH {_ALERTS} SELECT event_id, rule_id FROM alerts ORDER BY {_RANK} DESC, us DESC, event_id DESC, rule_id DESC LIMIT 10 OFFSET 10")
def alert_page(spark, sf_dir):
    rows = _alerts(spark, sf_dir).orderBy(Q.severity_rank(F.col("severity")).desc(), F.desc("ts"), F.desc("event_id"), F.desc("rule_id"))
    return rows.offset(10).limit(10).select("event_id", "rule_id")


@query("filtered_alerts", f"WITH {_ALERTS} SELECT event_id, rule_id, score FROM alerts WHERE severity = 'high' AND platform = 'windows' AND score >= 80")
def filtered_alerts(spark, sf_dir):
    return Q.filter_all(_alerts(spark, sf_dir), "high", "windows", 80).select("event_id", "rule_id", "score")


@query("first_filter_only", f"WITH {_ALERTS} SELECT event_id, rule_id FROM alerts WHERE severity = 'critical'")
def first_filter_only(spark, sf_dir):
    return Q.query_first_filter(_alerts(spark, sf_dir), severity="critical", platform="linux", min_score=149).select("event_id", "rule_id")


@query("export_selection", f"WITH {_ALERTS}, newest AS (SELECT * FROM alerts ORDER BY us DESC, event_id DESC, rule_id DESC LIMIT 1000) SELECT event_id, rule_id FROM newest WHERE platform = 'macos' AND score >= 70")
def export_selection(spark, sf_dir):
    rows = _alerts(spark, sf_dir).withColumn("_tie", F.struct("event_id", "rule_id"))
    return Q.export_selection(rows, platform="macos", min_score=70, limit=1000, tie="_tie").select("event_id", "rule_id")


# ------------------------------------------------------------- identity, episodes

# White space outside quotes becomes one space: quoted stretches (an open quote runs to the end), white space, other text.
_NORM = r"""trim(array_to_string(list_transform(regexp_extract_all(trim(cmd), '"[^"]*(?:"|\z)|''[^'']*(?:''|\z)|\s+|[^\s"'']+'), lambda x: CASE WHEN regexp_matches(x, '^\s') THEN ' ' ELSE x END), ''))"""
# JSON text of the fingerprint.
_FP = r"""'{"command_line":' || to_json(CASE WHEN platform = 'windows' THEN lower(NORM) ELSE NORM END) || ',"host":' || to_json(host) || ',"parent_process_name":' || to_json(parent) || ',"platform":' || to_json(platform) || ',"process_name":' || to_json(proc) || ',"rule_id":' || to_json(rule_id) || ',"user":' || to_json(CASE WHEN platform = 'windows' THEN lower("user") ELSE "user" END) || ',"v":1}'""".replace("NORM", _NORM)
_PRINTED = f"{_ALERTS}, printed AS (SELECT *, sha256({_FP}) AS fingerprint FROM alerts)"


def _printed(spark, sf_dir) -> DataFrame:
    return episodes.with_fingerprints(_alerts(spark, sf_dir))


@query("fingerprint_alerts", f"WITH {_PRINTED} SELECT event_id, rule_id, fingerprint FROM printed")
def fingerprint_alerts(spark, sf_dir):
    return _printed(spark, sf_dir).select("event_id", "rule_id", "fingerprint")


_EPISODES = f"""{_PRINTED}, gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER w > 3600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM printed WINDOW w AS (PARTITION BY fingerprint ORDER BY us, event_id)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY fingerprint ORDER BY us, event_id) AS episode FROM gaps)"""


@query("dedup_episodes", f"WITH {_EPISODES} SELECT fingerprint, CAST(episode AS BIGINT) AS episode, count(*) AS occurrence_count, min(us) AS first_us, max(us) AS last_us, max(score) AS score, arg_min(event_id, us) AS first_event_id, arg_max(event_id, us) AS last_event_id FROM numbered GROUP BY fingerprint, episode")
def dedup_episodes(spark, sf_dir):
    e = episodes.episodes(_printed(spark, sf_dir), hours=1)
    return e.select("fingerprint", "episode", "occurrence_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "score", F.col("event_data.event_id").alias("first_event_id"), F.col("last_event_data.event_id").alias("last_event_id"))


@query("dedup_arrival_fold", f"WITH {_EPISODES} SELECT fingerprint, CAST(episode AS BIGINT) AS episode, count(*) AS occurrence_count, min(us) AS first_us, max(us) AS last_us FROM numbered GROUP BY fingerprint, episode")
def dedup_arrival_fold(spark, sf_dir):
    """Arrival in time order gives the same episodes as the gap sessions."""
    e = episodes.fold_arrivals(_printed(spark, sf_dir).withColumn("_us", F.unix_micros("ts")), hours=1, arrival="_us")
    return e.select("fingerprint", "episode", "occurrence_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


#: A fixed order of arrival that has little to do with time.
_ARRIVAL = "(event_id * 7919) % 100003"
_BEST = "(list_aggregate(list_transform(list_filter(f.eps, lambda x: x.l >= o.us - 3600000000 AND x.f <= o.us + 3600000000), lambda x: {'l': x.l, 'e': -x.e}), 'max')).e"
# alert by alert, those of all fingerprints side by side; an alert joins the episode within an hour that was seen last
_ARRIVED = f"""WITH RECURSIVE {_PRINTED}, ordered AS (
  SELECT fingerprint, us, row_number() OVER (PARTITION BY fingerprint ORDER BY {_ARRIVAL}, event_id) AS n FROM printed
), fold AS (
  SELECT fingerprint, n, [{{'e': 1::BIGINT, 'c': 1::BIGINT, 'f': us, 'l': us}}] AS eps FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.fingerprint, o.n, CASE WHEN {_BEST} IS NULL THEN list_append(f.eps, {{'e': len(f.eps) + 1, 'c': 1::BIGINT, 'f': o.us, 'l': o.us}})
    ELSE list_transform(f.eps, lambda x: CASE WHEN x.e = -({_BEST}) THEN {{'e': x.e, 'c': x.c + 1, 'f': least(x.f, o.us), 'l': greatest(x.l, o.us)}} ELSE x END) END
  FROM fold f JOIN ordered o ON o.fingerprint = f.fingerprint AND o.n = f.n + 1
), whole AS (SELECT fingerprint, unnest(arg_max(eps, n)) AS x FROM fold GROUP BY fingerprint)
SELECT fingerprint, x.e AS episode, x.c AS occurrence_count, x.f AS first_us, x.l AS last_us FROM whole"""


def _as_folded(e: DataFrame) -> DataFrame:
    return e.select("fingerprint", "episode", "occurrence_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query("dedup_arrival_out_of_order", _ARRIVED)
def dedup_arrival_out_of_order(spark, sf_dir):
    """Alerts arrive in a fixed order that is not that of time."""
    return _as_folded(episodes.fold_arrivals(_printed(spark, sf_dir).withColumn("_arrival", F.expr(_ARRIVAL)), hours=1, arrival="_arrival"))


@query("dedup_stream", _ARRIVED)
def dedup_stream(spark, sf_dir):
    """The same arrivals as a stream of four files, folded with keyed state; each episode as its last batch left it."""
    from pyspark.sql import Window

    from .streaming.ingest import fold_available

    folded = fold_available(_printed(spark, sf_dir).select("fingerprint", "ts", "event_id", "score", F.expr(_ARRIVAL).alias("arrival")), "arrival", F.floor(F.col("arrival") / 25001), 4, hours=1)
    last = Window.partitionBy("fingerprint", "episode").orderBy(F.desc("batch_id"))
    return _as_folded(folded.withColumn("_k", F.row_number().over(last)).where("_k = 1"))


@query("suppression_filter", f"""WITH {_PRINTED}, g AS (SELECT DISTINCT rule_id, proc, cmd, "user", parent FROM printed WHERE rule_id = 'WIN-006'), h AS (SELECT DISTINCT fingerprint FROM printed WHERE rule_id = 'LNX-006' AND host = 'h1')
SELECT event_id, rule_id, rule_id = 'WIN-006' OR fingerprint IN (SELECT fingerprint FROM h) AS suppressed FROM printed""")
def suppression_filter(spark, sf_dir):
    a = _printed(spark, sf_dir)
    common = [F.lit(None).cast("long").alias("suppression_id"), F.timestamp_seconds(F.lit(0)).alias("starts_at"), F.timestamp_micros(F.lit(_NOW + 1)).alias("expires_at"), F.lit(True).alias("active")]
    everywhere = a.where("rule_id = 'WIN-006'").select(F.col("activity_fingerprint").alias("fingerprint"), F.lit("global").alias("scope"), F.lit(None).cast("string").alias("scope_value"), *common)
    on_host = a.where("rule_id = 'LNX-006' AND fp_host = 'h1'").select("fingerprint", F.lit("host").alias("scope"), F.lit("h1").alias("scope_value"), *common)
    return episodes.suppress(a, everywhere.unionByName(on_host).distinct(), _now()).select("event_id", "rule_id", "suppressed")


# ------------------------------------------------------------- lineage and chains

_NODES = f"""{_PREP}, n AS (
  SELECT *, host || '|' || process_id || '|' || event_id AS key, trim(coalesce(parent_process_name, '')) AS pname FROM prep
), cand AS (
  SELECT c.key, p.key AS parent_key, row_number() OVER (PARTITION BY c.key ORDER BY p.us DESC, p.event_id DESC) AS r
  FROM n c JOIN n p ON p.host = c.host AND p.process_id = c.parent_process_id AND p.key <> c.key AND p.us <= c.us AND (c.pname = '' OR p.proc = c.parent)
), linked AS (SELECT key, parent_key FROM cand WHERE r = 1),
orphan AS (
  SELECT n.*, host || '|phantom|' || coalesce(CAST(parent_process_id AS VARCHAR), 'None') || '|' || parent || '|' || CASE WHEN parent_process_id IS NULL THEN key ELSE '' END AS parent_key
  FROM n WHERE (parent_process_id IS NOT NULL OR pname <> '') AND key NOT IN (SELECT key FROM linked)
), parents AS (SELECT key, parent_key FROM linked UNION ALL SELECT key, parent_key FROM orphan),
phantom AS (
  SELECT parent_key AS key, arg_min(platform, us) AS platform, regexp_extract(trim(arg_min(CASE WHEN pname <> '' THEN pname ELSE 'pid-' || parent_process_id END, us)), '[^/\\\\]*$') AS proc FROM orphan GROUP BY parent_key
), anchors AS (SELECT key, us FROM n WHERE platform = 'macos' AND proc = 'osascript' UNION ALL SELECT key, NULL FROM phantom WHERE platform = 'macos' AND proc = 'osascript')"""


@query("lineage_parent_asof", f"WITH {_NODES} SELECT key, parent_key FROM linked")
def lineage_parent_asof(spark, sf_dir):
    nodes = lineage.build(process_events(spark, sf_dir))
    return nodes.where("parent_key IS NOT NULL AND NOT contains(parent_key, '|phantom|')").select("key", "parent_key")


@query("lineage_phantoms", f"WITH {_NODES} SELECT parent_key AS key, count(*) AS children, arg_min(CASE WHEN pname <> '' THEN pname ELSE 'pid-' || parent_process_id END, us) AS process_name FROM orphan GROUP BY parent_key")
def lineage_phantoms(spark, sf_dir):
    return lineage.phantoms(process_events(spark, sf_dir))


@query("lineage_closure", f"WITH RECURSIVE {_NODES}, start AS (SELECT key FROM n WHERE proc = 'osascript'), walk AS (SELECT start.key AS anc, p.key, 1 AS depth FROM start JOIN parents p ON p.parent_key = start.key UNION SELECT w.anc, p.key, w.depth + 1 FROM walk w JOIN parents p ON p.parent_key = w.key WHERE w.depth < 64) SELECT anc, key, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY anc, key")
def lineage_closure(spark, sf_dir):
    nodes = lineage.build(process_events(spark, sf_dir))
    return lineage.all_descendants(nodes, nodes.where("name_norm = 'osascript' AND NOT is_phantom")).select("anc", "key", "depth")


def _chain_sql(window: int) -> str:
    """Direct children chains of two stages: shell below a script host, within the window."""
    return f"""WITH {_NODES}, kids AS (
  SELECT p.parent_key AS anchor, n.key, n.us, n.process_id FROM n JOIN parents p USING (key) WHERE n.proc IN ('sh', 'bash', 'zsh')
), paths AS (
  SELECT a.key AS anchor, kids.key AS last, coalesce(a.us, kids.us) AS first_us, kids.us AS last_us, row_number() OVER (PARTITION BY a.key ORDER BY kids.us, kids.process_id, kids.key) AS r
  FROM anchors a JOIN kids ON kids.anchor = a.key WHERE a.us IS NULL OR (kids.us >= a.us AND kids.us - a.us <= {window * 1_000_000}::BIGINT)
) SELECT anchor, last, first_us, last_us FROM paths WHERE r = 1"""


@query("chain_child", _chain_sql(86_400))
def chain_child(spark, sf_dir):
    return _two_stage(spark, sf_dir, 86_400)


@query("chain_window", _chain_sql(300))
def chain_window(spark, sf_dir):
    return _two_stage(spark, sf_dir, 300)


def _two_stage(spark, sf_dir, window: int) -> DataFrame:
    from .rules.model import Chain, Stage

    c = Chain("CHAIN-MAC-900", "shell below script", "macos", "high", window, (Stage("script", {"process_name": "osascript"}), Stage("shell", {"process_name_any": ["sh", "bash", "zsh"]}, "child")))
    found = chains.match_chains(lineage.build(process_events(spark, sf_dir)), [c])
    return found.select("anchor", F.col("stages")[1]["node_key"].alias("last"), F.unix_micros("first_timestamp").alias("first_us"), F.unix_micros("last_timestamp").alias("last_us"))


_MAC = f"""WITH RECURSIVE {_NODES}, walk AS (
  SELECT a.key AS anchor, a.us AS first_us, p.key, 1 AS depth FROM anchors a JOIN parents p ON p.parent_key = a.key
  UNION SELECT w.anchor, w.first_us, p.key, w.depth + 1 FROM walk w JOIN parents p ON p.parent_key = w.key JOIN n ON n.key = p.key WHERE w.depth < 64 AND (w.first_us IS NULL OR n.us - w.first_us <= 300000000)
), s1 AS (SELECT DISTINCT w.anchor, coalesce(w.first_us, n.us) AS first_us, n.key AS k1, n.us AS u1, n.process_id AS p1 FROM walk w JOIN n ON n.key = w.key WHERE n.proc IN ('sh', 'bash', 'zsh') AND (w.first_us IS NULL OR n.us - w.first_us <= 300000000)),
below AS (
  SELECT s.k1, p.key, 1 AS depth FROM (SELECT DISTINCT k1 FROM s1) s JOIN parents p ON p.parent_key = s.k1
  UNION SELECT b.k1, p.key, b.depth + 1 FROM below b JOIN parents p ON p.parent_key = b.key WHERE b.depth < 64
), s2 AS (
  SELECT DISTINCT s1.*, n.key AS k2, n.us AS u2, n.process_id AS p2 FROM s1 JOIN below b ON b.k1 = s1.k1 JOIN n ON n.key = b.key
  WHERE n.proc IN ('curl', 'wget') AND (contains(n.cmd_l, 'http://') OR contains(n.cmd_l, 'https://') OR contains(n.cmd_l, 'ftp://')) AND n.us >= s1.u1 AND n.us - s1.first_us <= 300000000
), best AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY u1, p1, k1, u2, p2, k2) AS r FROM s2)"""


@query("chain_descendant", f"{_MAC} SELECT anchor, k1, k2, first_us, u2 AS last_us FROM best WHERE r = 1")
def chain_descendant(spark, sf_dir):
    found = chains.match_chains(lineage.build(process_events(spark, sf_dir)), [c for c in CHAINS if c.id == "CHAIN-MAC-001"])
    return found.select("anchor", F.col("stages")[1]["node_key"].alias("k1"), F.col("stages")[2]["node_key"].alias("k2"), F.unix_micros("first_timestamp").alias("first_us"), F.unix_micros("last_timestamp").alias("last_us"))


_BAND_SQL = "CASE " + " ".join(f"WHEN score >= {least} THEN {_q(name)}" for least, name in S.BANDS) + " ELSE 'low' END"


def _stage_sql(stage, platform: str) -> str:
    """A chain stage over the nodes ``nn``; a phantom fails every test of its command line."""
    name = "lower(base)" if platform == "windows" else "base"
    out = []
    for kind, v in stage.match.items():
        if kind.startswith("process_name"):
            out.append(f"{name} IN ({', '.join(_q(basename(x, platform)) for x in ([v] if isinstance(v, str) else v))})")
        elif kind == "command_contains_any":
            out.append("NOT ph AND " + _any("cmd_l", [x.lower() for x in v]))
        else:
            raise ValueError(f"no SQL for {kind}")
    return " AND ".join(out)


def _stage_json(alias: str, stage: str, platform: str) -> str:
    name = f"lower({alias}.base)" if platform == "windows" else f"{alias}.base"
    iso = f"to_json(strftime(make_timestamp({alias}.us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {alias}.us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({alias}.us % 1000000 AS VARCHAR), 6, '0') END)"
    return f"""'{{"pid":' || coalesce(CAST({alias}.process_id AS VARCHAR), 'null') || ',"process_name":' || to_json({name}) || ',"stage":{_js_text(stage)},"timestamp":' || coalesce({iso}, 'null') || '}}'"""


def _js_text(text: str) -> str:
    import json

    return json.dumps(text, ensure_ascii=False)


def _chain_paths_sql(c) -> str:
    """The least path of each anchor of a chain whose stages all lie below the one before."""
    n, last = len(c.stages), len(c.stages) - 1
    joins, tests, order = "", [], []
    first = "s0.us"
    for k in range(1, n):
        joins += f" JOIN up u{k} ON u{k}.anc = s{k - 1}.key JOIN nn s{k} ON s{k}.key = u{k}.key"
        tests.append(f"({_stage_sql(c.stages[k], c.platform)})".replace("base", f"s{k}.base").replace("cmd_l", f"s{k}.cmd_l").replace("NOT ph", f"NOT s{k}.ph"))
        tests.append(f"(s{k - 1}.us IS NULL OR s{k}.us >= s{k - 1}.us) AND ({first} IS NULL OR s{k}.us - {first} <= {c.window_seconds * 1_000_000}::BIGINT)")
        first = f"coalesce({first}, s{k}.us)"
        order += [f"s{k}.us", f"coalesce(s{k}.process_id, -1)", f"s{k}.key"]
    anchor = _stage_sql(c.stages[0], c.platform).replace("base", "s0.base").replace("cmd_l", "s0.cmd_l").replace("NOT ph", "NOT s0.ph")
    stages = " || ',' || ".join(_stage_json(f"s{k}", st.name, c.platform) for k, st in enumerate(c.stages))
    conf = f"least(100, {S.CHAIN_BASE + S.CHAIN_STAGE * max(0, n - 2)} + CASE WHEN s0.ph THEN 0 ELSE {S.CHAIN_CONCRETE} END)"
    return f"""SELECT {_q(c.id)} AS chain_id, s0.host, {_q(c.severity)} AS severity, {S.SEVERITY[c.severity]} AS sub, {conf} AS confidence, {first} AS first_us, s{last}.us AS last_us, {n} AS n_stages,
      sha256('{{"chain_id":{_js_text(c.id)},"host":' || to_json(lower(s0.host)) || ',"platform":{_js_text(c.platform)},"stages":[' || {stages} || '],"v":1}}') AS fingerprint,
      row_number() OVER (PARTITION BY s0.key ORDER BY {', '.join(order)}) AS r
    FROM nn s0{joins} WHERE s0.platform = {_q(c.platform)} AND {anchor} AND {' AND '.join(tests)}"""


_INCIDENTS = f"""WITH RECURSIVE {_NODES}, up AS (
  SELECT key, parent_key AS anc, 1 AS d FROM parents UNION SELECT u.key, p.parent_key, u.d + 1 FROM up u JOIN parents p ON p.key = u.anc WHERE u.d < 64
), nn AS (
  SELECT key, host, us, process_id, platform, regexp_extract(trim(process_name), '[^/\\\\]*$') AS base, cmd_l, false AS ph FROM n
  UNION ALL SELECT parent_key, any_value(host), NULL, any_value(parent_process_id), arg_min(platform, us), regexp_extract(trim(arg_min(CASE WHEN pname <> '' THEN pname ELSE 'pid-' || parent_process_id END, us)), '[^/\\\\]*$'), '', true FROM orphan GROUP BY parent_key
), paths AS ({" UNION ALL ".join(_chain_paths_sql(c) for c in CHAINS)}),
found AS (SELECT *, CAST(floor((sub * (100 + 3 * confidence) * 3 + 400) / 800.0) AS INTEGER) AS score FROM paths WHERE r = 1),
incidents AS (SELECT chain_id, host, severity, score, {_BAND_SQL} AS risk_band, CAST(confidence AS INTEGER) AS confidence, first_us, last_us, CAST(n_stages AS INTEGER) AS n_stages, fingerprint FROM found)"""


@query("incidents_scored", f"{_INCIDENTS} SELECT * FROM incidents")
def incidents_scored(spark, sf_dir):
    found = chains.incidents(lineage.build(process_events(spark, sf_dir)), CHAINS)
    return found.select("chain_id", "host", "severity", "score", "risk_band", "confidence", F.unix_micros("first_timestamp").alias("first_us"), F.unix_micros("last_timestamp").alias("last_us"), F.size("stages").alias("n_stages"), "fingerprint")


@query("incident_filters", f"{_INCIDENTS} SELECT chain_id, host, score, fingerprint FROM incidents WHERE severity = 'critical' AND score >= 100")
def incident_filters(spark, sf_dir):
    found = chains.incidents(lineage.build(process_events(spark, sf_dir)), CHAINS)
    return Q.get_incidents(found, severity="critical", min_score=100, limit=None).select("chain_id", "host", "score", "fingerprint")


@query("chains_over_batches", f"{_INCIDENTS} SELECT chain_id, host, score, first_us, last_us, fingerprint FROM incidents WHERE n_stages = 2")
def chains_over_batches(spark, sf_dir):
    """The chains of two stages over three batches in the order of time, each correlated with what the store keeps of those before."""
    from .streaming.ingest import correlate

    store, short = _store(spark), [c for c in CHAINS if len(c.stages) == 2]
    events = materialize(process_events(spark, sf_dir), "events")
    part = F.floor((F.unix_micros("ts") - 1704067200000000) / 10_000_000_000)
    for k in range(3):
        here = events.where((part >= k if k == 2 else part == k) if k else part <= 0)
        store.transact(lambda tx, here=here: tx.insert_absent("incidents", correlate(tx, here, short), "fingerprint"))
    return store.read("incidents").select("chain_id", "host", "score", F.unix_micros("first_timestamp").alias("first_us"), F.unix_micros("last_timestamp").alias("last_us"), "fingerprint")


# ------------------------------------------------------------- export

_ESC = r"replace(replace(replace(replace({c}, '\', '\\'), '=', '\='), chr(10), ' '), chr(13), ' ')"
_T = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S')"


def _field(name: str, sql: str) -> str:
    return f"CASE WHEN coalesce({sql}, '') <> '' THEN '{name}=' || {_ESC.format(c=sql)} END"


_CEF = ", ".join([
    _field("rt", _T), _field("suser", '"user"'), _field("cs1", "command_line"), "CASE WHEN coalesce(command_line, '') <> '' THEN 'cs1Label=commandLine' END", "'cat=alert'", _field("externalId", "rule_id"),
    _field("cn2", "CAST(score AS VARCHAR)"), "'cn2Label=riskScore'", _field("reason", "mitre"), _field("sproc", "process_name"), _field("sourceProcessName", "parent_process_name"),
])


@query("export_cef", f"WITH {_ALERTS} SELECT 'CEF:0|nightjar|nightjar|1|' || rule_id || '|' || replace(rule_name, '|', '\\|') || '|' || CASE risk_band WHEN 'critical' THEN '10' WHEN 'high' THEN '8' WHEN 'medium' THEN '5' ELSE '3' END || '|' || concat_ws(' ', {_CEF}) AS line FROM alerts")
def export_cef(spark, sf_dir):
    return export.alerts_to_cef(_alerts(spark, sf_dir))


def _js(**fields: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{k.replace('__', '@')}":' || {v}""" for k, v in fields.items()) + " || '}'"


_TEXT = lambda c: f"to_json(coalesce({c}, ''))"
_DESCRIPTIONS = "CASE rule_id " + " ".join(f"WHEN {_q(r.id)} THEN {_q(r.description)}" for r in RULES) + " END"
_ECS = _js(
    __timestamp=_TEXT(_T), event=_js(kind="'\"alert\"'", category="'[\"process\"]'", type="'[\"info\"]'", risk_score="score", severity="score", dataset="'\"nightjar.alert\"'"),
    rule=_js(id=_TEXT("rule_id"), name=_TEXT("rule_name"), description=_TEXT(_DESCRIPTIONS)),
    process=_js(name=_TEXT("process_name"), command_line=_TEXT("command_line"), parent=_js(name=_TEXT("parent_process_name"))), user=_js(name=_TEXT('"user"')), host=_js(name="'\"\"'"),
    nightjar=_js(kind="'\"alert\"'", severity=_TEXT("severity"), risk_band=_TEXT("risk_band")),
)
_ECS = f"""left({_ECS}, -1) || CASE WHEN mitre <> '' THEN ',"threat":{{"technique":{{"id":' || to_json(string_split(mitre, ',')) || '}}}}' ELSE '' END || ',"observer":{{"vendor":"nightjar","product":"nightjar"}}}}'"""


@query("export_ecs", f"WITH {_ALERTS} SELECT {_ECS} AS line FROM alerts")
def export_ecs(spark, sf_dir):
    return export.alerts_to_ecs(_alerts(spark, sf_dir))


@query("ingest_stream_available_now", f"WITH {_ALERTS} SELECT event_id, rule_id, score FROM alerts")
def ingest_stream_available_now(spark, sf_dir):
    """The stream over a folder of event files finds the same alerts as the batch."""
    from .storage import new_folder
    from .streaming.ingest import run_available

    root = new_folder(spark, "stream")
    process_events(spark, sf_dir).repartition(4).write.parquet(f"{root}/in")
    run_available(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", RULES)
    return spark.read.parquet(f"{root}/out").select("event_id", "rule_id", "score")


# ------------------------------------------------------------- sources: log lines made from the events, read back

_PLAIN = "replace(command_line, '\"', chr(39))"


def _log(spark, sf_dir, platform: str) -> DataFrame:
    rows = process_events(spark, sf_dir).where(F.col("platform") == platform)
    return rows.withColumn("k", F.pmod(F.col("process_id"), F.lit(7))).withColumn("_plain", F.replace("command_line", F.lit('"'), F.lit("'")))


def _parsed(events: DataFrame) -> DataFrame:
    return events.select(_micros("ts"), "platform", "process_name", "command_line", "user", "process_id", "parent_process_name", "parent_process_id", "working_directory")


def _expected(platform: str, **columns: str) -> str:
    base = {"us": "us // 1000 * 1000", "platform": "platform", "process_name": r"regexp_extract(process_name, '[^/\\]*$')", "command_line": "command_line", "user": '"user"', "process_id": "process_id", "parent_process_name": r"nullif(regexp_extract(parent_process_name, '[^/\\]*$'), '')", "parent_process_id": "parent_process_id", "working_directory": "working_directory"} | columns
    where = base.pop("where", "true")
    return f"WITH {_PREP} SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in base.items()) + f" FROM (SELECT *, process_id % 7 AS k7 FROM prep WHERE platform = '{platform}') WHERE {where}"


@query("parse_auditd", _expected("linux", command_line=_PLAIN, process_name=f"regexp_extract(split_part({_PLAIN}, ' ', 1), '[^/]*$')", user="CASE k7 WHEN 0 THEN 'root' WHEN 1 THEN 'root' WHEN 2 THEN 'deploy' ELSE CAST(1000 + k7 AS VARCHAR) END", parent_process_name="CAST(NULL AS VARCHAR)"))
def parse_auditd(spark, sf_dir):
    """Audit records (SYSCALL, EXECVE, CWD lines out of order, one of them twice, one that no number fits) as events, with user names from a table."""
    from .sources import auditd

    arg = lambda x, i: F.concat(F.lit("a"), i.cast("string"), F.lit('="'), x, F.lit('"'))
    parts = F.split("_plain", " ")
    msg = F.concat(F.lit("msg=audit("), F.format_string("%d.%03d", F.floor(F.unix_micros("ts") / 1_000_000), F.floor(F.unix_micros("ts") / 1000) % 1000), F.lit(":"), F.col("process_id").cast("string"), F.lit("): "))
    uid = F.when(F.col("k") == 0, "").when(F.col("k") == 1, " uid=0").otherwise(F.concat(F.lit(" uid="), (F.col("k") + 1000).cast("string")))
    ppid = F.coalesce(F.concat(F.lit(" ppid="), F.col("parent_process_id").cast("string")), F.lit(""))
    execve = F.concat(F.lit("type=EXECVE "), msg, F.lit("argc="), F.size(parts).cast("string"), F.lit(" "), F.array_join(F.transform(parts, arg), " "))
    lines = F.array(
        F.concat(F.lit("type=EXECVE "), msg, F.lit('argc=1 a0="stale"')), F.coalesce(F.concat(F.lit("type=CWD "), msg, F.lit('cwd="'), F.col("working_directory"), F.lit('"')), F.lit("type=PATH item=0")), execve,
        F.concat(F.lit("type=SYSCALL "), msg, F.lit("arch=c000003e syscall=59 pid="), F.col("process_id").cast("string"), ppid, uid),
        F.lit('type=EXECVE msg=audit(99999999999999999999.000:1): argc=900000000 a0="x"'),
    )
    rows = _log(spark, sf_dir, "linux").select("process_id", F.posexplode(lines).alias("o", "value")).select("value", F.lit("audit.log").alias("file"), (F.col("process_id") * 5 + F.col("o")).alias("at"))
    users = spark.createDataFrame([(0, "root"), (1002, "deploy")], "uid long, name string")
    return _parsed(auditd.events_from_lines(rows, users))


@query("parse_sysmon", _expected("windows", where="k7 <> 3 AND k7 <> 5"))
def parse_sysmon(spark, sf_dir):
    """Sysmon events as XML: other event ids and records without a user are left out, pids are hexadecimal or decimal, of two images the last counts."""
    from .sources import sysmon

    def text(c) -> object:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    data = lambda n, c: F.coalesce(F.concat(F.lit(f'<Data Name="{n}">'), text(c), F.lit("</Data>")), F.lit(f'<Data Name="{n}"/>'))
    pid = lambda c: F.when(F.col("k") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(c)))).otherwise(F.col(c).cast("string"))
    event = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>'), F.when(F.col("k") == 3, "5").otherwise("1"), F.lit("</EventID></System><EventData>"),
        data("UtcTime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")), data("ProcessId", pid("process_id")), data("Image", F.lit("first.exe")), data("Image", F.col("process_name")), data("CommandLine", F.col("command_line")),
        data("User", F.when(F.col("k") != 5, F.col("user"))), data("ParentImage", F.col("parent_process_name")), data("ParentProcessId", pid("parent_process_id")), data("CurrentDirectory", F.col("working_directory")), F.lit("</EventData></Event>"),
    )
    return _parsed(sysmon.events_from_xml(_log(spark, sf_dir, "windows").select(event.alias("value"))))


@query("parse_endpoint_security", _expected("macos", user="CASE k7 WHEN 0 THEN 'root' WHEN 1 THEN \"user\" ELSE 'uid:' || k7 END", where="k7 <> 6"))
def parse_endpoint_security(spark, sf_dir):
    """Endpoint Security records as JSON lines: other event kinds, blank and broken lines are left out."""
    from .sources import endpoint_security

    path = lambda c: F.struct(F.struct(F.col(c).alias("path")).alias("executable"))
    token = F.struct(F.col("process_id").alias("pid"), F.when(F.col("k") != 1, F.col("k")).alias("euid"))
    exec_ = F.struct(path("process_name").alias("target"), F.split("command_line", " ").alias("args"), F.col("working_directory").alias("cwd"))
    doc = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), F.when(F.col("k") == 1, F.col("user")).alias("user"),
        F.struct(token.alias("audit_token"), F.col("parent_process_id").alias("ppid"), F.struct(F.col("parent_process_name").alias("path")).alias("executable")).alias("process"),
        F.struct(F.when(F.col("k") != 6, exec_).alias("exec"), F.when(F.col("k") == 6, F.lit("fork")).alias("other")).alias("event"),
    )
    lines = F.array(F.to_json(doc), F.lit(" "), F.lit('{"event": {"exec": '), F.lit('{"time": 99999999999999, "process": [], "event": {"exec": 3}}'))
    return _parsed(endpoint_security.events_from_lines(_log(spark, sf_dir, "macos").select(F.explode(lines).alias("value"))))


# ------------------------------------------------------------- further scores, text and the store

_PARENT_RULE = Rule("WIN-900", "Started by the desktop", "windows", "high", {"process_name": "powershell.exe", "parent_process": "explorer.exe"})


@query("score_parent_rule", f"""{_ALERTS.split(", hits AS (")[0].join(["WITH ", ""])}, hit AS (
  SELECT *, {", ".join(f"({sql}) AS {n}" for n, sql in _FLAGS.items())} FROM prep WHERE platform = 'windows' AND proc = 'powershell.exe' AND parent = 'explorer.exe'
), c AS (
  SELECT *, least(100, 35 + {S.CRITERIA[2]} + {S.PARENT["suspicious_parent_match"]} + CASE WHEN upper("user") IN ('SYSTEM', 'NT AUTHORITY\\SYSTEM', 'ROOT') AND (encoded_payload OR download_cradle) THEN 15 ELSE 0 END
    + least(25, {" + ".join(f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in A.WEIGHTS.items())})) AS confidence FROM hit
) SELECT event_id, CAST(confidence AS INTEGER) AS confidence_subscore, CAST(floor((75 * (100 + 3 * confidence) * 3 + 400) / 800.0) AS INTEGER) AS score FROM c""")
def score_parent_rule(spark, sf_dir):
    """A rule that names the parent process: a matching parent adds to the confidence."""
    return detect(process_events(spark, sf_dir), [_PARENT_RULE], explain=False).select("event_id", "confidence_subscore", "score")


_WHITE, _ADMIN = list(S.WHITELIST.items()), list(S.ADMIN.items())
_case = lambda value, pairs: f"CASE {value} " + " ".join(f"WHEN {k} THEN {v}" for k, (_, v) in enumerate(pairs)) + " END"


@query("score_deltas", f"""WITH {_PREP}, d AS (
  SELECT event_id, {S.CRITERIA[2]} AS crit, {_case("event_id % 5", _WHITE)} AS white, {_case("event_id // 5 % 5", _ADMIN)} AS admin,
         CASE WHEN event_id % 2 = 0 THEN 12 ELSE 0 END AS usr, CASE WHEN event_id % 3 = 0 THEN -15 WHEN event_id % 3 = 1 THEN -5 ELSE 0 END AS part FROM prep
), c AS (SELECT event_id, CAST(greatest(0, least(100, 35 + crit + white + usr + CASE WHEN usr > 0 THEN 0 ELSE admin END + part)) AS INTEGER) AS confidence FROM d)
SELECT event_id, confidence, CAST(floor((50 * (100 + 3 * confidence) * 3 + 400) / 800.0) AS INTEGER) AS score FROM c""")
def score_deltas(spark, sf_dir):
    """Allow-list, administrator and partial-match adjustments of the confidence."""
    n = F.col("event_id")
    pick = lambda value, pairs: F.get(F.array(*[F.lit(k) for k, _ in pairs]), value.cast("int"))
    none, two = F.array().cast("array<string>"), F.array(F.lit("process_name"), F.lit("command_regex"))
    found = S.assess(
        F.lit("medium"), two, two, F.lit("neutral_lineage"), F.when(n % 2 == 0, "non_admin_privileged_tool").otherwise("neutral"), none, pick(n % 5, _WHITE), pick(F.floor(n / 5) % 5, _ADMIN), F.lit("and"), n % 3 == 0,
        F.when(n % 3 == 1, F.array(F.lit("command_regex"))).otherwise(none), explain=False,
    )
    return process_events(spark, sf_dir).select("event_id", found["confidence_subscore"].alias("confidence"), found["score"].alias("score"))


@query("display_texts", f"""WITH {_PREP} SELECT event_id, CASE WHEN length(command_line) > 20 THEN left(command_line, 17) || '...' ELSE command_line END AS short,
  strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') END AS iso,
  CASE WHEN ({_NOW} - us) < 60000000 THEN 'Just now' WHEN ({_NOW} - us) // 60000000 < 60 THEN ({_NOW} - us) // 60000000 || 'm ago' WHEN ({_NOW} - us) // 60000000 < 1440 THEN ({_NOW} - us) // 3600000000 || 'h ago' ELSE ({_NOW} - us) // 86400000000 || 'd ago' END AS age,
  CASE WHEN event_id % 4 = 0 THEN lower(host) WHEN event_id % 4 = 1 THEN 'named' ELSE '' END AS host FROM prep""")
def display_texts(spark, sf_dir):
    """Shortened commands, ISO and relative times, and the host that a raw record names."""
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, F.to_json(F.struct(F.upper(F.concat(F.col("host"), F.lit(".."))).alias("hostname")))).when(n % 4 == 1, F.lit('{"Computer": "Named.", "hostname": ""}')).otherwise("{}")
    return process_events(spark, sf_dir).select("event_id", X.truncate(F.col("command_line"), 20).alias("short"), X.iso_time(F.col("ts")).alias("iso"), X.relative_time(F.col("ts"), _now()).alias("age"), X.host_of(raw).alias("host"))


@query("store_append_scan", f"WITH {_ALERTS} SELECT event_id, rule_id, score, us FROM alerts WHERE score >= 80 AND platform <> 'macos'")
def store_append_scan(spark, sf_dir):
    """Alerts appended to the store in two parts and read back with filters."""
    store, found = _store(spark), _alerts(spark, sf_dir).select("event_id", "rule_id", "score", "platform", "ts")
    store.append("alerts", found.where("platform = 'windows'"))
    store.append("alerts", found.where("platform <> 'windows'"))
    return store.read("alerts").where("score >= 80 AND platform <> 'macos'").select("event_id", "rule_id", "score", _micros("ts"))


@query("store_insert_absent", f"WITH {_PRINTED} SELECT DISTINCT fingerprint, platform = 'linux' AS is_duplicate FROM printed")
def store_insert_absent(spark, sf_dir):
    """One row per fingerprint; those of Linux are there already."""
    store, found = _store(spark), _printed(spark, sf_dir).select("fingerprint", "platform")
    store.insert_absent("seen", found.where("platform = 'linux'"), "fingerprint")
    return store.insert_absent("seen", found, "fingerprint").select("fingerprint", "is_duplicate")


def _store(spark):
    from .storage import new_folder

    return Store(spark, new_folder(spark, "store"))
