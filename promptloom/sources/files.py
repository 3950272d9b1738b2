"""Scans (S1-S17): the text and JSON formats that prompts, phrases and paraphrases come in, as tables.

Files are read whole, one row a file, and parsed by built-in expressions; `ord` keeps the order of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions.text import clean_divider, py_strip

#: Only so many generated prompts are distinct.
LAST_PROMPT = 34
USER_PROMPTS = "struct<all_prompts:array<string>,prompts_by_category:map<string,array<string>>>"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of each file."""
    return spark.read.text(path, wholetext=True)


def _lines(files: DataFrame) -> DataFrame:
    return files.select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))


def phrases_strict(files: DataFrame) -> DataFrame:
    """Ord, phrase, word_count, prompt_id of each `"phrase" | N words | prompt_k`; repeats stay."""
    rule = F.lit(r'"([^"]+)"\s*\|\s*(\d+)\s*words?\s*\|\s*prompt_(\d+)')
    parts = F.arrays_zip(*[F.regexp_extract_all("value", rule, F.lit(i)).alias(n) for i, n in ((1, "p"), (2, "w"), (3, "k"))])
    return files.select(F.posexplode(parts).alias("ord", "x")).select("ord", F.col("x.p").alias("phrase"), F.col("x.w").cast("int").alias("word_count"), F.col("x.k").cast("int").alias("prompt_id"))


def phrases_prefixed(files: DataFrame) -> DataFrame:
    """Lines that start with a quote, up to `" |`."""
    line = py_strip(F.col("line"))
    return _lines(files).filter(F.startswith(line, F.lit('"')) & F.contains(line, F.lit('" |'))).select("ord", F.expr("""substr(split_part(regexp_replace(line, '(?U)^\\\\s+|\\\\s+\\\\z', ''), '" |', 1), 2)""").alias("phrase"))


def phrases_loose(files: DataFrame, strict: bool = True) -> DataFrame:
    """S3: any line of three parts; the header line too with strict=False."""
    line = py_strip(F.col("line"))
    parts = F.transform(F.split(line, r"\|"), lambda x: py_strip(x))
    rows = _lines(files).filter(F.contains("line", F.lit("|")) & ~line.rlike("^[=-]")).select("ord", parts.alias("x")).filter(F.size("x") >= 3)
    rows = rows.filter(~F.col("x")[0].rlike("^Format:")) if strict else rows
    return rows.select("ord", F.regexp_replace(F.col("x")[0], r'^"+|"+\z', "").alias("phrase"), F.col("x")[1].alias("words"), F.col("x")[2].alias("prompt"))


def phrases_quoted(files: DataFrame) -> DataFrame:
    """The first quoted part of a line with a bar."""
    return _lines(files).filter(F.contains("line", F.lit("|"))).select("ord", F.regexp_extract("line", '"([^"]+)"', 1).alias("phrase")).filter("phrase <> ''")


def prompts_scored(files: DataFrame, last: int | None = LAST_PROMPT) -> DataFrame:
    """Blocks between rows of exactly 80 `=`; ids up to `last` (F17); line breaks inside stay."""
    block = files.select(F.posexplode(F.split("value", "={80}")).alias("ord", "raw")).select("ord", py_strip(F.col("raw")).alias("b"))
    head = F.element_at(F.split("b", "\n"), 1)
    rows = block.filter(F.startswith("b", F.lit("Prompt")) & F.contains("b", F.lit("\n"))).select(
        F.regexp_extract(head, r"Prompt (\d+)", 1).try_cast("int").alias("prompt_id"), py_strip(F.expr("substr(b, instr(b, '\n') + 1)")).alias("text")
    ).filter("prompt_id is not null")
    return rows.filter(F.col("prompt_id") <= last) if last is not None else rows


def prompts_positional(files: DataFrame) -> DataFrame:
    """Parts between headers, over 20 characters, numbered from 1 by position in the file."""
    part = files.select("value", F.posexplode(F.split("value", r"Prompt \d+:\s*")).alias("ord", "raw")).select("value", "ord", clean_divider(F.col("raw"), 10).alias("text")).filter(F.length("text") > 20)
    return part.select(F.row_number().over(Window.partitionBy(F.xxhash64("value")).orderBy("ord")).alias("prompt_id"), "text")


def prompts_labelled(files: DataFrame) -> DataFrame:
    """The header's own number; bodies of at least 20 characters."""
    rule = F.lit(r"(?ms)^\s*Prompt\s+(\d+):\s*(.*?)(?:\n=+\s*\n|\z)")
    both = F.arrays_zip(F.regexp_extract_all("value", rule, F.lit(1)).alias("k"), F.regexp_extract_all("value", rule, F.lit(2)).alias("t"))
    return files.select(F.explode(both).alias("x")).select(F.col("x.k").cast("int").alias("prompt_id"), py_strip(F.col("x.t")).alias("text")).filter(F.length("text") >= 20)


def prompts_flattened(files: DataFrame) -> DataFrame:
    """The lines of each block, without blank ones and dividers, joined by a space."""
    block = files.select(F.posexplode(F.split("value", r"Prompt \d+:")).alias("ord", "raw")).filter("ord > 0")
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda x: py_strip(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("=")))
    return block.select(F.col("ord").alias("prompt_id"), F.array_join(lines, " ").alias("text"))


def paraphrases(files: DataFrame, key: Column | None = None, top: int | None = None) -> DataFrame:
    """Phrase, variant_no, variant, similarity from blocks `N. ORIGINAL: "p"` with numbered quoted lines below.

    A phrase that returns later in the file starts anew, so its last block counts; `top` keeps the first so many
    variants. An ORIGINAL line without quotes belongs to the block before it."""
    rows = files.select(F.xxhash64("value").alias("f"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    head = F.nullif(F.regexp_extract("line", r'ORIGINAL:\s*"(.+)"', 1), F.lit(""))
    inside = Window.partitionBy("f").orderBy("ord")
    marked = rows.select("f", "ord", "line", head.alias("h")).withColumn("phrase", F.last("h", True).over(inside)).withColumn("block", F.last(F.when(F.col("h").isNotNull(), F.col("ord")), True).over(inside))
    found = marked.filter(F.col("phrase").isNotNull() & F.col("h").isNull()).select(
        "f", "ord", "phrase", "block", F.regexp_extract("line", r'^\s+\d+\.\s*"(.+)"', 1).alias("variant"), F.regexp_extract("line", r"\(similarity:\s*([0-9.]+)\)", 1).try_cast("double").alias("similarity")
    ).filter("variant <> ''")
    own = key if key is not None else F.col("phrase")
    last = found.withColumn("__key", own).withColumn("__last", F.max(F.struct("f", "block")).over(Window.partitionBy("__key"))).filter("__last.f = f and __last.block = block")
    out = last.select("phrase", F.row_number().over(Window.partitionBy("f", "block").orderBy("ord")).alias("variant_no"), "variant", "similarity")
    return out.filter(F.col("variant_no") <= top) if top else out


def user_prompts(files: DataFrame) -> DataFrame:
    """Category, ord, text from JSON: an object with all_prompts, else prompts_by_category, else any object of
    lists, or a bare list; other JSON has no prompts and fails."""
    v = F.col("value")
    known, other, plain = F.from_json(v, USER_PROMPTS), F.from_json(v, "map<string,string>"), F.from_json(v, "array<string>")

    def entry(category: Column, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(category.alias("category"), t.alias("text")))

    none = F.lit(None).cast("string")
    by_category = F.flatten(F.transform(F.map_entries(known["prompts_by_category"]), lambda e: entry(e["key"], e["value"])))
    lists = F.flatten(F.transform(F.map_entries(F.map_filter(other, lambda k, x: F.startswith(x, F.lit("[")))), lambda e: entry(e["key"], F.from_json(e["value"], "array<string>"))))
    is_list = py_strip(v).startswith("[")
    is_object = py_strip(v).startswith("{")
    found = F.when(is_list, entry(none, plain)).when(~is_object, F.raise_error(F.lit("user prompts: neither a list nor an object"))).otherwise(F.coalesce(entry(none, known["all_prompts"]), by_category, lists))
    return files.select(F.posexplode(found).alias("ord", "x")).select("x.category", "ord", "x.text")


def categories(files: DataFrame) -> DataFrame:
    """Category, ord, text from prompts_by_category."""
    return files.select(F.explode(F.from_json("value", USER_PROMPTS)["prompts_by_category"]).alias("category", "t")).select("category", F.posexplode("t").alias("ord", "text"))


def first_path(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, in any file system that Spark knows."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    return None


def ready(spark: SparkSession, needed: dict[str, list[str]]) -> dict[str, str | None]:
    """Each input's path, or None if none of its candidates exists; ready if no value is None."""
    return {name: first_path(spark, paths) for name, paths in needed.items()}


def results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, which are Parquet."""
    return spark.read.parquet(path)


def rows(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A data set's rows, read lazily."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)
