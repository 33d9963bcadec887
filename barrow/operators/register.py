"""Register queries: a declarative register over joined tables, searched, filtered, ordered, paged and counted in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barrow.functions.text import icontains
from barrow.session import cut


@dataclass(frozen=True)
class Register:
    """What a register offers: its columns in order, which may be searched and ordered by, and keys of named filters."""

    columns: tuple[str, ...]
    searchable: tuple[str, ...] = ()
    orderable: tuple[str, ...] = ()
    named: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Request:
    search: str = ""
    column_search: dict[str, str] = field(default_factory=dict)
    named: dict[str, str] = field(default_factory=dict)
    order: str | None = None
    descending: bool = False
    start: int = 0
    length: int = 25


def as_text(df: DataFrame, name: str) -> Column:
    """A column as searchable text: timestamps by minute, booleans as words."""
    kind = dict(df.dtypes)[name]
    return F.date_format(name, "yyyy-MM-dd HH:mm") if kind == "timestamp" else F.col(name).cast("string")


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def global_predicate(df: DataFrame, columns: tuple[str, ...], needle: str) -> Column:
    """Whether the needle stands in any of the columns, joined ones included (FLT-02); an empty needle stands in all."""
    return reduce(lambda a, b: a | b, [icontains(as_text(df, c), needle) for c in columns]) if needle and columns else F.lit(True)


def column_predicate(df: DataFrame, register: Register, needles: dict[str, str]) -> Column:
    """Whether each needle stands in its column, by the column's index as text (FLT-03).

    Indexes that are no numbers or out of range, unsearchable columns and empty needles are passed over.
    """
    wanted = [(register.columns[int(i)], n) for i, n in needles.items() if i.isdigit() and int(i) < len(register.columns) and n]
    return _all([icontains(as_text(df, name), needle) for name, needle in wanted if name in register.searchable])


def named_predicate(df: DataFrame, register: Register, values: dict[str, str]) -> Column:
    """Whether all named filters hold (FLT-04): each key means the register's own column, or the joined card's.

    Unknown keys and empty values are passed over.
    """
    wanted = [(next((c for c in register.named.get(key, ()) if c in df.columns), None), value) for key, value in values.items() if value]
    return _all([icontains(as_text(df, name), value) for name, value in wanted if name])


def predicate(df: DataFrame, register: Register, request: Request) -> Column:
    return global_predicate(df, register.searchable, request.search) & column_predicate(df, register, request.column_search) & named_predicate(df, register, request.named)


def global_search(df: DataFrame, columns: tuple[str, ...], needle: str) -> DataFrame:
    return df.where(global_predicate(df, columns, needle))


def column_search(df: DataFrame, register: Register, needles: dict[str, str]) -> DataFrame:
    return df.where(column_predicate(df, register, needles))


def named_filters(df: DataFrame, register: Register, values: dict[str, str]) -> DataFrame:
    return df.where(named_predicate(df, register, values))


def visible(df: DataFrame, mode: str, user_id: int, public: str = "is_public", owner: str = "user_id") -> DataFrame:
    """FLT-05: 'private' one's own rows that are not public, 'public' the public ones, else all. Null counts as not public."""
    shown = F.coalesce(F.col(public), F.lit(False))
    return df.where(~shown & (F.col(owner) == user_id)) if mode == "private" else df.where(shown) if mode == "public" else df


def visible_any(df: DataFrame, user_id: int, public: str = "is_public", owner: str = "user_id") -> DataFrame:
    """FLT-08: public rows and one's own private rows, as one filter, so no row twice."""
    return df.where(F.coalesce(F.col(public), F.lit(False)) | F.coalesce(F.col(owner) == user_id, F.lit(False)))


def with_card(df: DataFrame, mode: str, key: str = "account_card_id") -> DataFrame:
    """FLT-06: rows with ('available') or without ('not_available') a card; any other mode keeps all."""
    return df.where(F.col(key).isNotNull()) if mode == "available" else df.where(F.col(key).isNull()) if mode == "not_available" else df


def without_excluded(df: DataFrame, show_excluded: bool = True, flag: str = "is_excluded") -> DataFrame:
    """FLT-07: excluded rows go unless they are to be shown; null is not excluded."""
    return df if show_excluded else df.where(~F.coalesce(F.col(flag), F.lit(False)))


def not_in(df: DataFrame, name: str, values: list) -> DataFrame:
    """FLT-10: NOT IN that keeps nulls."""
    return df.where(~F.coalesce(F.col(name).isin(*values), F.lit(False)))


def ordered(df: DataFrame, register: Register, request: Request, key: str) -> DataFrame:
    """SRT-01: by one column, nulls last going up and first going down, ties by key; by key alone if it can't be ordered by."""
    if request.order in register.orderable:
        c = F.col(request.order)
        return df.orderBy(c.desc_nulls_first() if request.descending else c.asc_nulls_last(), F.col(key).asc())
    return df.orderBy(F.col(key).asc())


def page(df: DataFrame, start: int, length: int) -> DataFrame:
    """LIM-01, LIM-04 on an ordered frame; a negative length means no end."""
    df = df.offset(start) if start else df
    return df.limit(length) if length >= 0 else df


def filtered(df: DataFrame, register: Register, request: Request) -> DataFrame:
    return df.where(predicate(df, register, request))


def respond(df: DataFrame, register: Register, request: Request, key: str, once: bool = False) -> DataFrame:
    """The page of a register query: filtered, ordered, cut, and only then projected.

    once: rows with equal keys are copies of each other and count once; it is the hits that are told apart, so the filter
    reaches the scan and no other row is shuffled.
    """
    hits = filtered(df, register, request)
    hits = hits.dropDuplicates([key]) if once else hits
    return page(ordered(hits, register, request, key), request.start, request.length).select(*register.columns)


def page_info(total: int, number: int, size: int = 100) -> dict:
    """LIM-04: the page asked for, brought into range, with has_next, has_previous and total_pages; no rows make one page."""
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    return {"number": number, "start": (number - 1) * size, "length": size, "total_pages": pages, "has_next": number < pages, "has_previous": number > 1}


def numbered_pages(df: DataFrame, key: str, size: int = 100) -> DataFrame:
    """LIM-04 over a whole frame: each row with its page number, the pages there are and whether one follows.

    Rows are numbered by key through range partitions: counts of the partitions are summed, no single task orders all rows.
    """
    parted = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    counted = parted.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.expr("sum(_c) over (order by _part) - _c").alias("_before"), F.expr("sum(_c) over ()").alias("_all"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("_before")
    numbered = parted.join(counted, "_part").withColumn("page", F.floor(place / size).cast("int") + 1).withColumn("total_pages", F.ceil(F.col("_all") / size).cast("int"))
    return numbered.withColumn("has_next", F.col("page") < F.col("total_pages")).drop("_part", "_before", "_all")


def found(df: DataFrame, key: str, value) -> dict:
    """SRC-02: the row of a key as a dict; LookupError if there is none. The filter reaches the scan, copies are one row."""
    row = df.where(F.col(key) == F.lit(value)).limit(1).collect()
    if not row:
        raise LookupError(f"no row with {key} = {value}")
    return row[0].asDict()


def counts(df: DataFrame, register: Register, request: Request, key: str | None = None) -> DataFrame:
    """AGG-01: recordsTotal and recordsFiltered in one pass: the filter is counted, not scanned for again.

    With a key, rows with equal keys count once; keys alone are shuffled, folded map-side.
    """
    if key:
        df = df.select(key, F.coalesce(predicate(df, register, request), F.lit(False)).alias("_kept")).groupBy(key).agg(F.max("_kept").alias("_kept"))
        return df.agg(F.count("*").alias("records_total"), F.count_if("_kept").alias("records_filtered"))
    return df.agg(F.count("*").alias("records_total"), F.count_if(predicate(df, register, request)).alias("records_filtered"))


def cells(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ-04: display cells by {display: column}: null as '', booleans as Да and Нет, timestamps by minute."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        if kinds[name] == "boolean":
            return F.when(F.col(name), "Да").when(~F.col(name), "Нет").otherwise("")
        return F.coalesce(as_text(df, name), F.lit(""))

    return df.select(*[cell(c).alias(d) for d, c in mapping.items()])


def pruned(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-01: the named columns; none named means all."""
    return df.select(*columns) if columns else df


#: Path of each kind of object under the site's base address.
OBJECT_PATHS = {"act": "acts", "scientificreport": "scientific_reports", "techreport": "tech_reports", "openlists": "open_lists", "objectaccountcard": "account_cards", "archaeologicalheritagesite": "archaeological_heritage_sites", "identifiedarchaeologicalheritagesite": "identified_archaeological_heritage_sites", "commercialoffers": "map/commercial_offer", "geoobject": "map/geo_object"}


def object_url(base: str, kind: Column, key: Column, admin: str = "admin") -> Column:
    """PRJ-08: address of an object; kinds without a page of their own lead to the admin's."""
    paths = F.create_map(*[F.lit(x) for kv in OBJECT_PATHS.items() for x in kv])
    return F.concat(F.lit(f"{base}/"), F.coalesce(paths[kind], F.concat(F.lit(f"{admin}/"), kind)), F.lit("/"), key.cast("string"), F.lit("/"))


def group_style(name: Column) -> Column:
    """PRJ-10: style of a coordinate group by the first keyword in its name; null means the group is not drawn."""
    has = lambda word: F.contains(name, F.lit(word))
    return F.when(has("фотофиксации"), "photos").when(has("Каталог"), "catalog").when(has("Шурфы"), "pits").when(has("Центр"), "center")


def coordinate_points(df: DataFrame, key: str, coordinates: str = "coordinates") -> DataFrame:
    """PRJ-07: a heterogeneous {group: {meta, point: [lat, lon]}} column as flat points in ring order.

    (key, grp, coord_system, point_name, pos, lat, lon); pos counts from 0 within the group's entries; entries that are no
    pair of numbers are dropped (FLT-18); null and malformed JSON has no points.
    """
    groups = df.select(F.col(key).alias("_key"), F.explode(F.from_json(coordinates, "map<string,string>")).alias("grp", "body"))
    body = F.from_json("body", "map<string,string>")
    points = groups.select("_key", "grp", F.get_json_object("body", "$.coordinate_system").alias("coord_system"), F.posexplode(body).alias("pos", "point_name", "value"))
    pair = F.from_json("value", "array<double>")
    points = points.where(~F.col("point_name").isin("coordinate_system", "area")).withColumn("_pair", pair).where(F.size("_pair") == 2)
    return points.select(F.col("_key").alias(key), "grp", "coord_system", "point_name", "pos", F.col("_pair")[0].alias("lat"), F.col("_pair")[1].alias("lon"))


def rings(points: DataFrame, key: str) -> DataFrame:
    """AGG-18: the points of each group as one ring in order: (key, grp, coord_system, ring)."""
    ring = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return points.groupBy(key, "grp").agg(F.first("coord_system").alias("coord_system"), ring.alias("ring"))
