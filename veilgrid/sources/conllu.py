"""CoNLL-U Plus and CoNLL-2003: readers, validation, writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import label_type, stable_number

BASE = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc", "start", "end")


def lines(spark: SparkSession, paths, name: Column | None = None, encoding: str = "UTF-8") -> DataFrame:
    """doc, line_no, line: the lines of each file in order, one row per line. UTF-16 files may have a byte order mark.

    Order inside a file is kept by reading it whole; a file is a document, so this is bounded by a document.
    """
    if encoding == "UTF-8":
        text = spark.read.option("wholetext", True).text(paths)
    else:
        text = spark.read.format("binaryFile").load(paths).withColumn("value", F.decode("content", encoding))
    text = text.withColumn("doc", name if name is not None else F.col("_metadata.file_path"))
    return text.select("doc", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def from_lines(rows: DataFrame, columns: tuple[str, ...] | None = None, separator: str = "\t") -> DataFrame:
    """doc, sent_id, pos, fields..., from lines(doc, line_no, line). Comments go; a blank line ends a sentence."""
    order = Window.partitionBy("doc").orderBy("line_no")
    rows = rows.withColumn("blank", (F.trim("line") == "").cast("int"))
    rows = rows.withColumn("block", F.coalesce(F.sum("blank").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tokens = rows.filter(F.col("line").rlike(r"^\d+\s") if separator == "\t" else (F.col("blank") == 0) & ~F.col("line").rlike(r"^(-DOCSTART|# )"))
    tokens = tokens.withColumns({"sent_id": F.dense_rank().over(Window.partitionBy("doc").orderBy("block")) - 1, "pos": F.row_number().over(order) - 1, "fields": F.split("line", separator)})
    if columns is None:
        return tokens.select("doc", "sent_id", "pos", "fields")
    return tokens.select("doc", "sent_id", "pos", *[F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def metadata(rows: DataFrame) -> DataFrame:
    """doc, meta: the ``# key = value`` comments before the first token as a map."""
    first = Window.partitionBy("doc")
    rows = rows.withColumn("until", F.min(F.when(F.col("line").rlike(r"^\d+\s"), F.col("line_no"))).over(first))
    pairs = rows.filter(F.col("line").rlike(r"^#\s*[^=]+=") & (F.coalesce("until", F.lit(1 << 30)) > F.col("line_no")))
    key, value = F.trim(F.regexp_extract("line", r"^#\s*([^=]+)=", 1)), F.trim(F.regexp_extract("line", r"^#\s*[^=]+=(.*)$", 1))
    last = pairs.groupBy("doc", key.alias("key")).agg(F.max_by(value, F.col("line_no")).alias("value"))
    return last.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))


def with_declared_columns(rows: DataFrame) -> DataFrame:
    """doc, sent_id, pos, token: a map keyed by the names in ``global.columns``, or by place where none are declared."""
    names = metadata(rows).select("doc", F.split(F.trim(F.col("meta")["global.columns"]), r"\s+").alias("names"))
    tokens = from_lines(rows).join(names, "doc", "left")
    places = F.transform(F.sequence(F.lit(0), F.size("fields") - 1), lambda k: k.cast("string"))
    n = F.least(F.size("fields"), F.size("names"))
    named = F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice("fields", F.lit(1), n))
    return tokens.select("doc", "sent_id", "pos", F.when(F.col("names").isNull(), F.map_from_arrays(places, F.col("fields"))).otherwise(named).alias("token"))


def validate(rows: DataFrame) -> DataFrame:
    """doc, valid: equal field counts, integer ids that run 1, 2, ... in each block. A file without tokens is valid."""
    order = Window.partitionBy("doc").orderBy("line_no")
    rows = rows.withColumn("pause", (F.trim("line") == "") | F.startswith("line", F.lit("#")))
    rows = rows.withColumn("block", F.sum(F.col("pause").cast("int")).over(order))
    own = rows.filter(~F.col("pause")).withColumns({"size": F.size(F.split("line", "\t")), "id": F.split_part("line", F.lit("\t"), F.lit(1))})
    own = own.withColumn("due", F.row_number().over(Window.partitionBy("doc", "block").orderBy("line_no")))
    ok = F.every(F.col("id").rlike(r"^\d+$") & (F.expr("try_cast(id as bigint)") == F.col("due")))
    found = own.groupBy("doc").agg(ok.alias("ids"), (F.min("size") == F.max("size")).alias("even"))
    return rows.select("doc").distinct().join(found, "doc", "left").select("doc", (F.coalesce("ids", F.lit(True)) & F.coalesce("even", F.lit(True))).alias("valid"))


def validate_all(rows: DataFrame) -> DataFrame:
    """valid: whether every file is; no file at all is valid."""
    return validate(rows).agg(F.coalesce(F.every("valid"), F.lit(True)).alias("valid"))


def write_parts(tokens: DataFrame, columns: list[str], path: str, seed: int = 7) -> None:
    """The train, dev and test files of ``train_split`` under path/part=..., one text row per document."""
    parts = train_split(tokens.select("doc").distinct(), seed)
    render(tokens, columns).join(parts, "doc").select("part", "value").write.partitionBy("part").text(path)


def require_fields(tokens: DataFrame, least: int = 14) -> DataFrame:
    """tokens(fields) whose rows have at least ``least`` fields; fewer raise."""
    return tokens.withColumn("fields", F.when(F.size("fields") >= least, F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.size("fields").cast("string")))))


def render(tokens: DataFrame, columns: list[str], rename: dict[str, str] | None = None, meta: DataFrame | None = None) -> DataFrame:
    """doc, value: the text of a CoNLL-U Plus file. tokens(doc, sent_id, pos, columns...); missing values are ``_``."""
    names = [(rename or {}).get(c, c) for c in columns]
    line = F.concat_ws("\t", *[F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("_")) for c in columns])
    sentence = tokens.groupBy("doc", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    sentence = sentence.select("doc", "sent_id", F.array_join(F.col("l.line"), "\n").alias("text"))
    out = sentence.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sent_id", "text"))).alias("s"))
    head = F.lit(f"# global.columns = {' '.join(n.upper() for n in names)}\n")
    if meta is not None:
        out = out.join(meta, "doc", "left")
        entries = F.filter(F.array_sort(F.map_entries(F.coalesce("meta", F.create_map().cast("map<string,string>")))), lambda e: e["key"] != "global.columns")
        head = F.concat(head, F.array_join(F.transform(entries, lambda e: F.concat(F.lit("# "), e["key"], F.lit(" = "), e["value"], F.lit("\n"))), ""))
    return out.select("doc", F.concat(head, F.array_join(F.col("s.text"), "\n\n"), F.lit("\n\n")).alias("value"))


def ner_of(tokens: DataFrame, field: int = -1) -> DataFrame:
    """+ type: the label of the last (or given) field without its prefix, null if void."""
    return tokens.withColumn("ner", F.element_at("fields", field if field < 0 else field + 1)).withColumn("type", label_type(F.col("ner")))


def train_split(tokens: DataFrame, seed: int = 7) -> DataFrame:
    """+ part: train, dev or test (60, 20, 20 of a hundred) by a hash of the document, so reruns agree."""
    h = F.pmod(stable_number(F.concat(F.col("doc").cast("string"), F.lit(f":{seed}"))), F.lit(100))
    return tokens.withColumn("part", F.when(h < 60, "train").when(h < 80, "dev").otherwise("test"))
