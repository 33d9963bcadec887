"""The archive's entities: their field lists (PRJ-03), named filters by key (FLT-04), links and maps over several of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrow.operators.register import global_predicate, visible, with_card, without_excluded

#: Keys of the named filters.
NAMED_KEYS = (
    "name", "creation_time", "address", "object_type", "general_classification", "description", "usage", "discovery_info", "compiler", "compile_date",
    "number", "holder", "object", "works", "start_date", "end_date", "organization", "author", "writing_date", "upload_source",
    "year", "finish_date", "type", "name_number", "place", "customer", "area", "expert", "executioner", "open_list", "conclusion", "border_objects",
    "owner", "source", "date_uploaded", "doc_name", "district", "document", "register_num",
)
#: Keys that stand for a column of another name.
ALIASES = {"owner": ("username", "card_username"), "source": ("upload_source",)}

#: Fields of each entity as it is served.
_REPORT = "id user supplement name organization author open_list writing_date introduction contractors place area_info research_history results conclusion"
SHAPES = {
    "user": "id username last_login is_superuser first_name last_name email is_staff is_active date_joined",
    "user_tasks": "id user task_id files_type upload_source",
    "act": "id user supplement year finish_date type name_number place customer area expert executioner open_list conclusion border_objects act start_date exp_place exp_customer relationship goal object docs exp_info exp_facts literature exp_conclusion",
    "scientific_report": _REPORT,
    "tech_report": _REPORT,
    "open_list": "id user origin_filename date_uploaded upload_source is_processing is_public number holder object works start_date end_date source",
    "account_card": "id user date_uploaded upload_source is_processing is_public name creation_time address object_type general_classification description usage discovery_info compiler supplement coordinates source",
    "archaeological_site": "id account_card date_uploaded doc_name district document register_num is_excluded",
    "identified_site": "id account_card date_uploaded name address obj_info document is_excluded",
    "commercial_offer": "id user date_uploaded upload_source is_processing is_public origin_filename coordinates source",
    "geo_object": "id user date_uploaded upload_source is_processing is_public origin_filename name type coordinates source",
    "geojson": "id name geojson",
    "chat": "id user name created_at",
    "message": "id chat sender sender_name content sent_at",
}


def shape(df: DataFrame, entity: str) -> DataFrame:
    """PRJ-03: the served fields of an entity; a reference is its key, a field the table lacks is null."""

    def field(name: str) -> Column:
        column = next((c for c in (name, f"{name}_id") if c in df.columns), None)
        return (F.col(column) if column else F.lit(None)).alias(name)

    return df.select(*map(field, SHAPES[entity].split()))


def named_columns(df: DataFrame) -> dict[str, str]:
    """FLT-04: the column of df each named filter means: its own, else the joined card's (card_...)."""
    offered = {key: [c for k in ALIASES.get(key, (key,)) for c in (k, f"card_{k}")] for key in NAMED_KEYS}
    return {key: next(c for c in names if c in df.columns) for key, names in offered.items() if any(c in df.columns for c in names)}


def named(df: DataFrame, values: dict, user_id: int | None = None) -> DataFrame:
    """FLT-04..07: rows for which all named filters hold; unknown keys and empty values are passed over.

    Beside the text keys: storage_type ('private' needs user_id, without one nothing is private), account_card_filter and
    show_excluded, on tables that have what they ask of.
    """
    columns = named_columns(df)
    wanted = [global_predicate(df, (columns[k],), str(v)) for k, v in values.items() if v and k in columns]
    df = df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df
    mode = values.get("storage_type")
    if "is_public" in df.columns and (mode == "public" or mode == "private" and user_id is not None and "user_id" in df.columns):
        df = visible(df, mode, user_id)
    if "account_card_id" in df.columns:
        df = with_card(df, values.get("account_card_filter", ""))
    return without_excluded(df, values.get("show_excluded", True)) if "is_excluded" in df.columns else df


def map_of_reports(reports: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """PRJ-05, PRJ-06: (report_type, id, shown, source) of all finished reports of several kinds, repeated rows once.

    reports: {kind: (table, what a report without a file name is called)}; the name is the first file's.
    """
    shown = F.get_json_object("source", "$[0].origin_filename")
    parts = [df.where(~F.coalesce("is_processing", F.lit(False))).select(F.lit(kind).alias("report_type"), "id", F.coalesce(shown, F.concat(F.lit(f"{called} №"), F.col("id").cast("string"))).alias("shown")).distinct() for kind, (df, called) in reports.items()]
    return reduce(DataFrame.unionByName, parts)


def owners_by_name(objects: DataFrame, identified: DataFrame, registered: DataFrame) -> DataFrame:
    """JOI-07: objects(name) with the site of exactly that name: (name, owner_kind, owner_id), identified sites first, the least
    id of several. Null names own nothing. identified and registered: (name, id)."""
    first = lambda df, kind: df.where("name is not null").groupBy("name").agg(F.min("id").alias(kind))
    joined = objects.select("name").where("name is not null").distinct().join(first(identified, "_i"), "name", "left").join(first(registered, "_r"), "name", "left")
    return joined.where("_i is not null or _r is not null").select("name", F.when(F.col("_i").isNotNull(), "identified").otherwise("registered").alias("owner_kind"), F.coalesce("_i", "_r").alias("owner_id"))


def card_of_folder(files: DataFrame, stored: DataFrame) -> DataFrame:
    """JOI-08: files(path) with the least stored(id, path) that has a file in the same folder: (path, id); else they are left out."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    held = stored.where("path is not null").groupBy(folder("path").alias("_dir")).agg(F.min("id").alias("id"))
    return files.where("path is not null").select("path", folder("path").alias("_dir")).distinct().join(held, "_dir").select("path", "id")


def messages(rows: DataFrame, users: DataFrame) -> DataFrame:
    """PRJ-09: messages with the sender as stored and, beside it, the name of the user it is, if it is one.

    rows(id, chat, sender, content, sent_at), users(id, username).
    """
    names = users.select(F.col("id").cast("string").alias("_u"), F.col("username").alias("sender_name"))
    return rows.withColumn("_u", F.col("sender").cast("string")).join(names, "_u", "left").select("id", "chat", F.col("sender").cast("string").alias("sender"), "sender_name", "content", "sent_at")


def picked_address(first: Column, second: Column, name: Column) -> Column:
    """STR-29: of a doubled address column the second value, else the first, else ''; one that repeats the name is none."""
    good = lambda c: F.when(c.isNotNull() & (F.trim(c) != F.coalesce(name, F.lit(""))), F.trim(c))
    return F.coalesce(good(second), good(first), F.lit(""))

