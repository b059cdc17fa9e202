"""Windows Sysmon process-creation events (event id 1) from XML, as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_events
from ..storage import skipping

_EVENT = r"(?s)<Event[ >].*?</Event>"
REQUIRED = ("ProcessId", "Image", "CommandLine", "User", "UtcTime")


def _unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&#10;", "\n"), ("&#13;", "\r"), ("&#9;", "\t"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def data_map(xml: Column) -> Column:
    """Name and text of an event's Data elements, as an array of structs; of elements of one name the last counts."""
    items = F.regexp_extract_all(xml, F.lit(r"""(?s)<Data\s+Name=["'][^"']*["']\s*(?:/>|>.*?</Data>)"""), F.lit(0))
    name = lambda x: F.regexp_extract(x, r"""Name=["']([^"']*)["']""", 1)
    value = lambda x: _unescape(F.regexp_extract(x, r"(?s)>(.*)</Data>$", 1))
    found = F.transform(items, lambda x, k: F.struct(name(x).alias("name"), (-k).alias("k"), value(x).alias("value")))
    ordered = F.array_sort(found)  # by name, the last first
    before = F.concat(F.array(F.lit(None).cast("struct<name:string,k:int,value:string>")), ordered)
    last = F.zip_with(ordered, before, lambda x, p: F.when(x["name"].isNotNull() & (p["name"].isNull() | (p["name"] != x["name"])), x))
    return F.transform(F.array_sort(F.transform(F.filter(last, lambda x: x.isNotNull()), lambda x: F.struct((-x["k"]).alias("k"), x["name"].alias("name"), x["value"].alias("value")))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def number(text: Column) -> Column:
    """Decimal or 0x hexadecimal; null if it is neither."""
    t = F.trim(text)
    hexa = F.when(t.rlike(r"^0[xX][0-9A-Fa-f]{1,15}$"), F.conv(F.substring(t, 3, 20), 16, 10).try_cast("long"))
    return F.coalesce(hexa, F.when(t.rlike(r"^[0-9]{1,18}$"), t.try_cast("long")))


def _once(rows: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each made once per row: conditions on a generated column are not moved in front of it with its expression."""
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def events_from_xml(xml: DataFrame) -> DataFrame:
    """``xml``: one Event element per row in ``value``; rows without a needed field or with a bad pid are left out."""
    rows = _once(xml.where(F.regexp_extract("value", r"<EventID[^>]*>\s*(\d+)\s*</EventID>", 1) == "1"), "value", data=data_map(F.col("value")))
    get = lambda k: F.get(F.transform(F.filter("data", lambda d: d["name"] == k), lambda d: d["value"]), F.lit(0))
    rows = _once(rows, "value", "data", **{k: get(k) for k in (*REQUIRED, "ParentImage", "ParentProcessId", "CurrentDirectory")})
    for k in REQUIRED:
        rows = rows.where(F.coalesce(F.col(k), F.lit("")) != "")
    base = lambda c: F.regexp_extract(c, r"[^/\\]*$", 0)
    ts = F.coalesce(F.try_to_timestamp("UtcTime", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp("UtcTime", F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp("UtcTime", F.lit("yyyy-MM-dd HH:mm:ss")))
    raw = F.to_json(F.struct(F.map_from_entries("data").alias("parsed")))
    out = rows.select(
        F.abs(F.xxhash64("value")).alias("event_id"), ts.alias("ts"), F.lit("windows").alias("platform"), base(F.col("Image")).alias("process_name"), F.col("CommandLine").alias("command_line"), F.col("User").alias("user"),
        number(F.col("ProcessId")).alias("process_id"), F.nullif(base(F.col("ParentImage")), F.lit("")).alias("parent_process_name"), number(F.col("ParentProcessId")).alias("parent_process_id"),
        F.nullif("CurrentDirectory", F.lit("")).alias("working_directory"), raw.alias("raw"),
    )
    return as_events(out.where("process_id IS NOT NULL AND ts IS NOT NULL"))


def read(spark: SparkSession, path: str | list[str], skip_bad: bool = False) -> DataFrame:
    """XML files that each hold one Event element; files with several are no valid document and give nothing."""
    return events_from_files(spark.read.options(**skipping(skip_bad)).text([path] if isinstance(path, str) else path, wholetext=True))


def events_from_files(whole: DataFrame) -> DataFrame:
    """``whole``: the text of one file per row in ``value``."""
    one = F.regexp_extract_all("value", F.lit(_EVENT), F.lit(0))
    return events_from_xml(whole.where(F.size(one) == 1).select(F.get(one, F.lit(0)).alias("value")))


def read_stream_of_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that hold any number of Event elements, split by the XML reader's row tag."""
    rows = spark.read.text([path] if isinstance(path, str) else path, lineSep="</Event>")
    return events_from_xml(rows.where(F.col("value").rlike(r"<Event[ >]")).select(F.concat(F.regexp_extract("value", r"(?s)<Event[ >].*$", 0), F.lit("</Event>")).alias("value")))


def split_buffer(text: str) -> tuple[list[str], int]:
    """Complete Event elements of a text buffer, and how many characters they consume; a partial tail stays."""
    import re

    found, end = [], 0
    for m in re.finditer(_EVENT, text):
        found.append(m[0])
        end = m.end()
    return found, end


def read_evtx(spark: SparkSession, path: str) -> DataFrame:
    """Binary EVTX files; needs the python-evtx library on every executor."""
    try:
        import Evtx.Evtx  # noqa: F401
    except ImportError as e:
        raise ImportError("reading .evtx files needs the python-evtx library; convert them to XML instead") from e
    import tempfile

    def records(batches):
        import pyarrow as pa
        from Evtx.Evtx import Evtx as Reader

        for b in batches:
            for content in b.column(0):
                with tempfile.NamedTemporaryFile(suffix=".evtx") as f:
                    f.write(content.as_py())
                    f.flush()
                    with Reader(f.name) as log:
                        yield pa.RecordBatch.from_arrays([pa.array([r.xml() for r in log.records()], pa.string())], ["value"])

    return events_from_xml(spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, "value string"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A log file by its suffix: binary .evtx, anything else XML."""
    return read_evtx(spark, path) if path.lower().endswith(".evtx") else read(spark, path)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's .evtx and .xml files; a folder without either has no events."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = None
    for suffix, reader in (("evtx", read_evtx), ("xml", read)):
        pattern = f"{folder.rstrip('/')}/*.{suffix}"
        if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)):
            part = reader(spark, pattern) if reader is read_evtx else reader(spark, pattern, skip_bad=True)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else events_from_xml(spark.createDataFrame([], "value string"))
