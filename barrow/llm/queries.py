"""Queries of the training-data problems over the archive's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrow.llm import addresses, leaks, names, packing, pieces, scans, stuffing
from barrow.session import cut, once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Fields that can exceed the size limit of problem 5.
LONG_FIELDS = {"acts": ("exp_info",), "scientific_reports": ("introduction", "research_history")}


def _fields(parts: dict[str, DataFrame], names: dict[str, tuple[str, ...]]) -> DataFrame:
    """(table_name, id, field, text): each table is read once for all its fields."""
    field = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("text"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "id", F.inline(F.array(*map(field, names[name])))) for name, df in parts.items()])


def _pieces_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _fields({name: once(spark, sf_dir, name, ["id"], list(fields)) for name, fields in LONG_FIELDS.items()}, LONG_FIELDS)
    return pieces.split_column(texts, ["table_name", "id", "field"], "text")


@query(
    """SELECT DISTINCT 'acts' AS table_name, id, 'exp_info' AS field FROM acts WHERE length(exp_info) > 3000
UNION ALL SELECT DISTINCT 'scientific_reports', id, 'introduction' FROM scientific_reports WHERE length(introduction) > 3000
UNION ALL SELECT DISTINCT 'scientific_reports', id, 'research_history' FROM scientific_reports WHERE length(research_history) > 3000"""
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the splitter had to cut: those with a second piece."""
    split = pieces.split_column(_fields({name: table(spark, sf_dir, name) for name in LONG_FIELDS}, LONG_FIELDS), ["table_name", "id", "field"], "text")
    return split.where((F.col("n_chars") > pieces.LIMIT) & (F.col("piece_no") == 2)).select("table_name", "id", "field").distinct()


@query()
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field in its ordered pieces; a repeated row counts once."""
    return _pieces_once(spark, sf_dir)


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, id, '{field}' AS field, length(x) AS n_chars, true AS fits, true AS overlaps, md5(x) AS digest FROM (SELECT id, any_value({field}) AS x FROM {name} GROUP BY id) WHERE length(x) > 0"
        for name, fields in LONG_FIELDS.items()
        for field in fields
    )
)
def p5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces put together again: whether all fit and overlap as they must, and the digest of what they make."""
    own = F.struct("piece_no", "start", "end", "piece")
    put = _pieces_once(spark, sf_dir).groupBy("table_name", "id", "field", "n_chars").agg(F.sort_array(F.collect_list(own)).alias("p"))
    rest = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct((a["end"] - b["start"]).alias("back"), F.substring(b["piece"], a["end"] - b["start"] + 1, F.length(b["piece"])).alias("new")))
    put = put.withColumn("rest", rest)
    text = F.concat(F.element_at("p", 1)["piece"], F.array_join(F.transform("rest", lambda r: r["new"]), ""))
    fits = F.forall("p", lambda x: (F.length(x["piece"]) <= pieces.LIMIT) & (F.length(x["piece"]) == x["end"] - x["start"]))
    return put.select("table_name", "id", "field", F.col("n_chars").cast("long").alias("n_chars"), fits.alias("fits"), F.forall("rest", lambda r: r["back"].between(1, pieces.OVERLAP)).alias("overlaps"), F.md5(text.cast("binary")).alias("digest"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents").select("doc_id", packing.count_tokens(F.col("text")).alias("n_tokens")))


@query()
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of 2,048 tokens, batches inside buckets: doc_id, part_no, start, n, container_id."""
    return packing.pack(_sized(spark, sf_dir), ["doc_id"], "n_tokens")


@query()
def p6_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with batches that go on into shorter buckets: fewer and fuller containers."""
    return packing.pack(_sized(spark, sf_dir), ["doc_id"], "n_tokens", mixed=True)


@query("SELECT count(*) AS documents, true AS fit, true AS whole, true AS gapless FROM documents")
def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the containers hold every document whole, none above its capacity, their numbers without gaps."""
    sized = _sized(spark, sf_dir)
    placed = packing.pack(sized, ["doc_id"], "n_tokens", mixed=True)
    used = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n") <= packing.CAPACITY, F.lit(True)).alias("fit"), (F.count("*") == F.coalesce(F.max("container_id") + 1, F.lit(0))).alias("gapless"))
    each = placed.groupBy("doc_id").agg(F.sum("n").alias("held"), F.count("*").alias("parts"), F.min("start").alias("lo"))
    told = sized.join(each, "doc_id", "full").agg(F.count("*").alias("documents"), F.bool_and(F.coalesce((F.col("held") == F.col("n_tokens")) & (F.col("lo") == 0) & (F.col("parts") == F.greatest(F.ceil(F.col("n_tokens") / packing.CAPACITY), F.lit(1))), F.lit(False))).alias("whole"))
    return told.withColumn("_", F.lit(1)).join(used.withColumn("_", F.lit(1)), "_").select("documents", "fit", "whole", "gapless")


@query()
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they hold twelve consecutive words."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("exact").select("doc_id", "item_id").distinct()


@query()
def p7_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that put a test item again with other numbers, names or units, and in how many windows."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), every=True)
    return found.where("not exact").select("doc_id", "item_id", "windows")


@query()
def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that follows the test set: items leaked, and items put again with other values."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), every=True)
    return found.groupBy("doc_id").agg(F.count_if("exact").alias("n_items"), F.count_if(~F.col("exact")).alias("n_items_again"))


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents most of whose text is keywords, links or tags."""
    return stuffing.scored(table(spark, sf_dir, "documents")).where("stuffed").select("doc_id").distinct()


@query()
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank-frequency fit of every document, its distance from prose and its divergence."""
    measures = ("slope", "residual", "top", "z_slope", "z_residual", "z_top", "divergence", "asked")
    return stuffing.scored(table(spark, sf_dir, "documents")).select("doc_id", "language", "n_words", *[F.round(c, 6).alias(c) for c in measures], "stuffed")


#: The free descriptions of places of problem 2, with the prefix of their records.
PLACES = (("acts", "place", "acts"), ("archaeological_heritage_sites", "district", "sites"), ("identified_archaeological_heritage_sites", "address", "identified"))


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that denote the same building or spot."""
    parts = [table(spark, sf_dir, name).where("id is not null").select(F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")).alias("rec"), F.col(field).alias("text")) for name, field, prefix in PLACES]
    return addresses.same_places(reduce(DataFrame.unionByName, parts))


#: The hand-typed names of problem 1.
NAMES = (("person", "acts", "expert"), ("person", "scientific_reports", "author"), ("organization", "acts", "executioner"), ("organization", "scientific_reports", "organization"))


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stored values that name the same person or organisation."""
    parts = [table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(field).alias("name")) for kind, name, field in NAMES]
    return names.same_names(reduce(DataFrame.unionByName, parts))


#: The scanned fields of problem 3.
SCANNED = {"acts": ("exp_facts", "conclusion"), "scientific_reports": ("introduction",)}


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of noise in each scanned field."""
    texts = _fields({name: table(spark, sf_dir, name) for name in SCANNED}, SCANNED)
    return scans.noise(texts, ["table_name", "id", "field"])


@query()
def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned field as continuous paragraphs; a repeated row counts once."""
    texts = _fields({name: once(spark, sf_dir, name, ["id"], list(fields)) for name, fields in SCANNED.items()}, SCANNED)
    return scans.repaired(texts, ["table_name", "id", "field"])
