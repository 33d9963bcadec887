"""The core's queries: one for each surveyed operator, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barrow.functions import geo, similarity, text
from barrow.operators import catalog, changes, extraction, grids, layout, matching, predicates, register, retrieval, snapshots, spatial
from barrow.operators.register import Register, Request, respond
from barrow.session import table
from barrow.sources import files as sources
from barrow.sources import kml, sinks
from barrow.streaming import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    r"""WITH bare AS (
  SELECT snapshot_no, regexp_replace(regexp_replace(upper(register_num), '[\s\p{Z}\x{0085}\x{200B}\x{FEFF}]+', '', 'g'), '[\p{Pd}\x{2212}]', '-', 'g') AS k, loaded_at,
         coalesce(trim(regexp_replace(doc_name, '[\s\p{Z}\x{0085}\x{200B}\x{FEFF}]+', ' ', 'g')), '') AS n, coalesce(is_excluded, false) AS x
  FROM heritage_site_snapshots),
held AS (
  SELECT snapshot_no, k, n, x FROM bare WHERE k <> '' AND snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, k ORDER BY loaded_at DESC NULLS LAST, n DESC, x DESC) = 1),
turns AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS nxt FROM (SELECT DISTINCT snapshot_no FROM heritage_site_snapshots WHERE snapshot_no IS NOT NULL)),
old AS (SELECT h.*, t.nxt FROM held h JOIN turns t USING (snapshot_no) WHERE t.nxt IS NOT NULL),
new AS (SELECT h.* FROM held h WHERE h.snapshot_no <> (SELECT min(snapshot_no) FROM turns))
SELECT coalesce(new.snapshot_no, old.nxt) AS snapshot_no, coalesce(new.k, old.k) AS register_num,
       CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old FULL JOIN new ON old.nxt = new.snapshot_no AND old.k = new.k
WHERE old.k IS NULL OR new.k IS NULL OR old.n <> new.n OR old.x <> new.x"""
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.register_changes(table(spark, sf_dir, "heritage_site_snapshots"))


# --- registers -------------------------------------------------------------------------------------------------------

ACTS = Register(
    columns=("id", "year", "finish_date", "type", "name_number", "place", "customer", "area", "expert", "executioner", "open_list", "username", "date_uploaded"),
    searchable=("year", "finish_date", "type", "name_number", "place", "customer", "area", "expert", "executioner", "open_list", "username", "date_uploaded"),
    orderable=("year", "finish_date", "name_number", "place", "date_uploaded"),
    named={k: (k,) for k in ("year", "finish_date", "type", "name_number", "place", "customer", "area", "expert", "executioner", "open_list", "conclusion", "border_objects", "upload_source", "date_uploaded")} | {"owner": ("username",), "source": ("upload_source",)},
)
SITES = Register(
    columns=("id", "doc_name", "district", "document", "register_num", "is_excluded", "card_name", "card_owner"),
    searchable=("doc_name", "district", "document", "register_num", "card_name", "card_address"),
    orderable=("doc_name", "register_num"),
    named={"doc_name": ("doc_name",), "district": ("district",), "document": ("document",), "register_num": ("register_num",), "name": ("doc_name",), "address": ("card_address",), "object_type": ("card_object_type",), "description": ("card_description",), "owner": ("card_owner",), "compiler": ("card_compiler",)},
)


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "users").select(F.col("id").alias("user_id"), "username", "email", "is_superuser")


def _acts(spark: SparkSession, d: str) -> DataFrame:
    """Acts that are not being processed, with their users (JOI-01, FLT-01). Copies are still there: hits are told apart
    after the filter, so that it reaches the scan."""
    return table(spark, d, "acts").where(~F.coalesce("is_processing", F.lit(False))).join(_users(spark, d), "user_id")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """Registered sites with their cards and the cards' owners, where there are any (JOI-02); copies of sites are still there."""
    cards = table(spark, d, "object_account_cards").dropDuplicates(["id"]).select(F.col("id").alias("account_card_id"), F.col("user_id").alias("card_user"), F.col("name").alias("card_name"), F.col("address").alias("card_address"), F.col("object_type").alias("card_object_type"), F.col("description").alias("card_description"), F.col("compiler").alias("card_compiler"))
    owners = _users(spark, d).select(F.col("user_id").alias("card_user"), F.col("username").alias("card_owner"))
    return table(spark, d, "archaeological_heritage_sites").join(cards, "account_card_id", "left").join(owners, "card_user", "left")


ONE_ACT = """(SELECT DISTINCT ON (a.id) a.*, u.username, u.email, u.is_superuser, strftime(a.date_uploaded AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS uploaded
 FROM acts a JOIN users u ON a.user_id = u.id WHERE NOT coalesce(a.is_processing, false) ORDER BY a.id)"""
ONE_SITE = """(SELECT DISTINCT ON (s.id) s.*, c.name AS card_name, c.address AS card_address, c.object_type AS card_object_type, c.description AS card_description, c.compiler AS card_compiler, u.username AS card_owner
 FROM archaeological_heritage_sites s LEFT JOIN (SELECT DISTINCT ON (id) * FROM object_account_cards ORDER BY id) c ON s.account_card_id = c.id LEFT JOIN users u ON c.user_id = u.id ORDER BY s.id)"""
_ANY = " OR ".join(f"contains(lower(coalesce(cast({c} AS varchar), '')), lower('гридардева'))" for c in (*ACTS.searchable[:-1], "uploaded"))
FLAGSHIP = Request(search="Гридардева", named={"place": "район"}, order="finish_date", descending=True, start=5, length=20)


@query(f"""SELECT id, year, finish_date, type, name_number, place, customer, area, expert, executioner, open_list, username, date_uploaded AT TIME ZONE 'UTC' AS date_uploaded
FROM {ONE_ACT} WHERE ({_ANY}) AND contains(lower(place), 'район') ORDER BY finish_date DESC NULLS FIRST, id LIMIT 20 OFFSET 5""")
def register_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole register query: search, filter, order, page (FLT-02, 04, JOI-01, SRT-01, LIM-01)."""
    return respond(_acts(spark, d), ACTS, FLAGSHIP, "id", once=True)


@query(f"SELECT id, username FROM {ONE_ACT} WHERE {_ANY}")
def register_global_search(spark: SparkSession, d: str) -> DataFrame:
    return register.global_search(_acts(spark, d), ACTS.searchable, "Гридардева").select("id", "username").distinct()


@query(f"SELECT id, place, expert FROM {ONE_ACT} WHERE contains(lower(place), 'верхнесойский') AND contains(lower(expert), 'прок')")
def register_column_search(spark: SparkSession, d: str) -> DataFrame:
    return register.column_search(_acts(spark, d), ACTS, {"5": "верхнесойский", "8": "ПРОК", "x": "никто", "99": "никто"}).select("id", "place", "expert").distinct()


@query(f"SELECT id, doc_name, card_owner FROM {ONE_SITE} WHERE contains(lower(doc_name), 'о') AND contains(lower(card_owner), 'user00') AND contains(lower(card_address), 'район')")
def register_named_filters(spark: SparkSession, d: str) -> DataFrame:
    """Named filters on the register's own and the joined card's columns (FLT-04, JOI-02, JOI-03)."""
    return register.named_filters(_sites(spark, d), SITES, {"name": "О", "owner": "user00", "address": "район", "unknown": "x", "document": ""}).select("id", "doc_name", "card_owner").distinct()


@query(f"SELECT id, is_public, user_id FROM {ONE_ACT} WHERE coalesce(is_public, false) OR user_id = 5")
def register_visibility(spark: SparkSession, d: str) -> DataFrame:
    return register.visible_any(_acts(spark, d), 5).select("id", "is_public", "user_id").distinct()


@query(f"SELECT id FROM {ONE_ACT} WHERE NOT coalesce(is_public, false) AND user_id = 5")
def register_private(spark: SparkSession, d: str) -> DataFrame:
    return register.visible(_acts(spark, d), "private", 5).select("id").distinct()


@query(f"SELECT id, register_num FROM {ONE_SITE} WHERE account_card_id IS NOT NULL AND NOT coalesce(is_excluded, false)")
def register_fk_null(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06, FLT-07."""
    return register.without_excluded(register.with_card(_sites(spark, d), "available"), show_excluded=False).select("id", "register_num").distinct()


@query(f"SELECT id, doc_name FROM {ONE_SITE} ORDER BY doc_name ASC NULLS LAST, id LIMIT 50 OFFSET 100")
def register_page(spark: SparkSession, d: str) -> DataFrame:
    return register.page(register.ordered(_sites(spark, d).select("id", "doc_name").distinct(), SITES, Request(order="doc_name"), "id"), 100, 50)


@query(f"SELECT count(*) AS records_total, count(*) FILTER (WHERE {_ANY}) AS records_filtered FROM {ONE_ACT}")
def register_counts(spark: SparkSession, d: str) -> DataFrame:
    return register.counts(_acts(spark, d), ACTS, Request(search="Гридардева"), "id")


@query(f"""SELECT coalesce(year, '') AS "Год", coalesce(place, '') AS "Место", CASE WHEN is_public THEN 'Да' WHEN NOT is_public THEN 'Нет' ELSE '' END AS "Открыт", coalesce(uploaded, '') AS "Загружен" FROM {ONE_ACT}""")
def register_cells(spark: SparkSession, d: str) -> DataFrame:
    acts = _acts(spark, d).select("id", "year", "place", "is_public", "date_uploaded").distinct()
    return register.cells(acts, {"Год": "year", "Место": "place", "Открыт": "is_public", "Загружен": "date_uploaded"})


@query("SELECT type AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM acts) WHERE type IS NULL OR type NOT IN ('ГИКЭ', 'гикэ') GROUP BY type")
def not_in_keeps_nulls(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, AGG-02."""
    return register.not_in(table(spark, d, "acts").distinct(), "type", ["ГИКЭ", "гикэ"]).groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT id, json_extract_string(upload_source, '$.link') AS link FROM acts WHERE user_id IN (SELECT id FROM users WHERE is_superuser) AND json_extract_string(upload_source, '$.source') <> 'Пользовательский файл'")
def tasks_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, FLT-12, JOI-04: crawled acts of superusers, by a semi join."""
    crawled = table(spark, d, "acts").where(F.get_json_object("upload_source", "$.source") != "Пользовательский файл")
    admins = table(spark, d, "users").where("is_superuser").select(F.col("id").alias("user_id"))
    return crawled.join(admins, "user_id", "left_semi").select("id", F.get_json_object("upload_source", "$.link").alias("link")).distinct()


@query("SELECT user_id, max(date_uploaded) AT TIME ZONE 'UTC' AS last_upload, arg_max(id, (date_uploaded, id)) AS id FROM acts GROUP BY user_id")
def top1_per_key(spark: SparkSession, d: str) -> DataFrame:
    """LIM-02: each user's newest act, by one aggregate."""
    return table(spark, d, "acts").groupBy("user_id").agg(F.max("date_uploaded").alias("last_upload"), F.max_by("id", F.struct("date_uploaded", "id")).alias("id"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds, count(*) AS n FROM events GROUP BY user_id")
def chat_ordered_messages(spark: SparkSession, d: str) -> DataFrame:
    """JOI-05, AGG-09, AGG-10: ordered histories by one aggregate."""
    told = retrieval.histories(table(spark, d, "events"), "user_id", "ts", ["event_id", "event_type"])
    return told.select("user_id", F.array_join(F.transform("messages", lambda m: m["event_type"]), ",").alias("kinds"), F.size("messages").cast("long").alias("n"))


@query("""SELECT c.id, coalesce('identified:' || i.i, 'site:' || s.i) AS owner FROM (SELECT DISTINCT id FROM object_account_cards) c
LEFT JOIN (SELECT account_card_id AS k, min(id) AS i FROM identified_archaeological_heritage_sites GROUP BY 1) i ON i.k = c.id
LEFT JOIN (SELECT account_card_id AS k, min(id) AS i FROM archaeological_heritage_sites GROUP BY 1) s ON s.k = c.id""")
def coalesce_precedence_join(spark: SparkSession, d: str) -> DataFrame:
    """JOI-06, LIM-03: the site of each card, identified sites first."""
    first = lambda name, label: table(spark, d, name).where("account_card_id is not null").groupBy(F.col("account_card_id").alias("id")).agg(F.concat(F.lit(f"{label}:"), F.min("id").cast("string")).alias(label))
    cards = table(spark, d, "object_account_cards").select("id").distinct()
    return cards.join(first("identified_archaeological_heritage_sites", "identified"), "id", "left").join(first("archaeological_heritage_sites", "site"), "id", "left").select("id", F.coalesce("identified", "site").alias("owner"))


@query("""WITH o AS (SELECT DISTINCT doc_name AS name FROM heritage_site_snapshots WHERE doc_name IS NOT NULL UNION SELECT name FROM identified_archaeological_heritage_sites WHERE name IS NOT NULL),
i AS (SELECT name, min(id) AS i FROM identified_archaeological_heritage_sites GROUP BY name), r AS (SELECT doc_name AS name, min(id) AS r FROM archaeological_heritage_sites GROUP BY 1)
SELECT o.name, CASE WHEN i IS NOT NULL THEN 'identified' ELSE 'registered' END AS owner_kind, coalesce(i, r) AS owner_id FROM o LEFT JOIN i USING (name) LEFT JOIN r USING (name) WHERE coalesce(i, r) IS NOT NULL""")
def exact_name_link(spark: SparkSession, d: str) -> DataFrame:
    """JOI-07: every name in the deliveries and lists with the site of exactly that name, identified sites first."""
    identified, registered = table(spark, d, "identified_archaeological_heritage_sites").select("name", "id"), table(spark, d, "archaeological_heritage_sites").select(F.col("doc_name").alias("name"), "id")
    objects = table(spark, d, "heritage_site_snapshots").select(F.col("doc_name").alias("name")).unionByName(identified.select("name"))
    return catalog.owners_by_name(objects, identified, registered)


@query("""WITH f AS (SELECT a.id, regexp_replace(json_extract_string(e.value, '$.path'), '/[^/]*$', '') AS dir FROM (SELECT id, source FROM acts UNION ALL SELECT id, source FROM scientific_reports) a, json_each(a.source) e)
SELECT dir, min(id) AS first_id, count(DISTINCT id) AS n FROM f WHERE dir IS NOT NULL GROUP BY dir""")
def folder_files(spark: SparkSession, d: str) -> DataFrame:
    """JOI-08: files by the folder they lie in."""
    both = table(spark, d, "acts").select("id", "source").unionByName(table(spark, d, "scientific_reports").select("id", "source"))
    return matching.files_of(both, "id").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("n")).where("dir is not null")


# --- files and matching ----------------------------------------------------------------------------------------------

FILES = "(SELECT a.id, json_extract_string(e.value, '$.path') AS path, json_extract_string(e.value, '$.origin_filename') AS origin_filename, json_extract_string(e.value, '$.file_hash') AS file_hash FROM acts a, json_each(a.source) e)"


@query(f"SELECT file_hash, min(id) AS kept, count(DISTINCT id) AS copies FROM {FILES} WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(DISTINCT id) > 1")
def hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return matching.duplicates(matching.files_of(table(spark, d, "acts"), "id"), "file_hash", "id")


@query("SELECT sha256(text) AS digest, min(doc_id) AS kept, count(DISTINCT doc_id) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def document_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return matching.duplicates(docs, "digest", "doc_id")


@query(f"""SELECT DISTINCT path, file_hash FROM {FILES} f WHERE id % 2 = 0 AND file_hash IS NOT NULL
AND path NOT IN (SELECT path FROM {FILES} WHERE id % 2 = 1 AND path IS NOT NULL) AND file_hash NOT IN (SELECT file_hash FROM {FILES} WHERE id % 2 = 1 AND file_hash IS NOT NULL)""")
def anti_join_new_files(spark: SparkSession, d: str) -> DataFrame:
    """MAT-04, MAT-05, SET-03, SET-04: files of one half of the acts that the other half lacks, by path, then by hash."""
    files = matching.files_of(table(spark, d, "acts"), "id")
    return matching.new_files(files.where("id % 2 = 0").select("path", "file_hash"), files.where("id % 2 = 1")).select("path", "file_hash").distinct()


@query(f"SELECT count(*) AS files, count(file_hash) AS hashed, count(DISTINCT origin_filename) AS names FROM {FILES}")
def file_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04, MAT-07: counts over the files of all acts."""
    return matching.files_of(table(spark, d, "acts"), "id").agg(F.count("*").alias("files"), F.count("file_hash").alias("hashed"), F.countDistinct("origin_filename").alias("names"))


@query(f"""SELECT path, name, extension FROM (SELECT *, row_number() OVER (PARTITION BY extension ORDER BY path) AS n FROM (
SELECT DISTINCT path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension FROM {FILES} WHERE path IS NOT NULL)
WHERE extension IN ('.pdf', '.docx') AND substr(name, 1, 1) NOT IN ('~', '.') AND NOT contains(lower(name), 'приказ') AND NOT contains(lower(name), 'решение')) WHERE n <= 25""")
def per_group_limit(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03, LIM-05: discovery with a limit for each extension."""
    files = matching.files_of(table(spark, d, "acts"), "id").select("path").where("path is not null").distinct()
    return sources.discovered(files, [".pdf", ".docx"], 25).select("path", "name", "extension")


KEYS = ["doc_name", "district", "document", "register_num"]
_STORED = "SELECT doc_name, district, document, register_num, max(coalesce(is_excluded, false)) AS old, true AS s FROM archaeological_heritage_sites GROUP BY ALL"
_LISTED = "SELECT DISTINCT doc_name, district, document, register_num, true AS n FROM heritage_site_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM heritage_site_snapshots)"
_SAME = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in KEYS)
_BOTH = ", ".join(f"CASE WHEN a.s THEN a.{k} ELSE b.{k} END AS {k}" for k in KEYS)
_RECONCILED = f"SELECT {_BOTH}, CASE WHEN b.n IS NULL THEN true WHEN a.s IS NULL THEN false ELSE %s END AS is_excluded FROM ({_STORED}) a FULL JOIN ({_LISTED}) b ON {_SAME}"


def _last_list(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "heritage_site_snapshots")
    return snaps.join(snaps.agg(F.max("snapshot_no").alias("snapshot_no")), "snapshot_no", "left_semi")


@query(_RECONCILED % "false")
def snapshot_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.reconcile(table(spark, d, "archaeological_heritage_sites"), _last_list(spark, d), KEYS, "is_excluded")


@query(_RECONCILED % "a.old")
def snapshot_reconcile_sticky(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.reconcile(table(spark, d, "archaeological_heritage_sites"), _last_list(spark, d), KEYS, "is_excluded", sticky=True)


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '_' || (n - 1) END AS key_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def key_suffixing(spark: SparkSession, d: str) -> DataFrame:
    return matching.suffixed(table(spark, d, "part"), ["p_brand"], "p_partkey").select("p_partkey", "key_name")


@query()
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    """MAT-08..11: acts uploaded by superusers against the other acts as a registry. No SQL has this similarity."""
    acts = table(spark, d, "acts").dropDuplicates(["id"])
    admins = table(spark, d, "users").where("is_superuser").select(F.col("id").alias("user_id"))
    return matching.best_matches(acts.join(admins, "user_id", "left_semi"), acts.join(admins, "user_id", "left_anti"), "id", "id")


# --- text ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT id, CASE WHEN lower(trim(coalesce(finish_date, ''))) IN ('', 'nan') THEN '' ELSE regexp_replace(trim(coalesce(finish_date, '')), '^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T].*)?$', '\3.\2.\1') END AS dotted,
CASE WHEN lower(trim(coalesce(year, ''))) = 'nan' THEN '' ELSE regexp_replace(trim(coalesce(year, '')), '\.0+$', '') END AS plain_year FROM acts""")
def date_spellings(spark: SparkSession, d: str) -> DataFrame:
    """STR-07, MAT-13."""
    return table(spark, d, "acts").select("id", text.dotted_date(F.col("finish_date")).alias("dotted"), text.year(F.col("year")).alias("plain_year")).distinct()


_MONTHS = ", ".join(f"('{m}', '{k:02d}')" for k, m in enumerate(text.MONTHS, 1))


@query(rf"""WITH w AS (SELECT DISTINCT id, start_date, regexp_extract(start_date, '([а-яА-ЯёЁ]+)', 1) AS word, regexp_extract(start_date, '(?:^|\D)(\d{{1,2}})(?:\D|$)', 1) AS day, regexp_extract(start_date, '(\d{{4}})', 1) AS y FROM acts WHERE start_date IS NOT NULL),
m AS (SELECT * FROM (VALUES {_MONTHS}) t(name, no)),
best AS (SELECT word, arg_min(no, (levenshtein(lower(word), name), no)) AS no, min(levenshtein(lower(word), name)) AS dist FROM (SELECT DISTINCT word FROM w WHERE word <> '') CROSS JOIN m GROUP BY word)
SELECT id, coalesce(nullif(CASE WHEN day = '' THEN '' ELSE lpad(day, 2, '0') END, ''), '-') || '.' || CASE WHEN word = '' THEN '-' WHEN dist <= 4 THEN no ELSE word END || '.' || CASE WHEN y = '' THEN '-' ELSE y END AS dots,
coalesce(regexp_matches(start_date, '«*(\d{{1,2}})»* *([а-яА-ЯёЁ]+) (\d{{4}})(?:\D|$)') AND lower(word) IN (SELECT name FROM m) AND try_cast(regexp_extract(start_date, '«*(\d+)»* *([а-яА-ЯёЁ]+) (\d+)', 1) AS int) <= 31 AND try_cast(regexp_extract(start_date, '«*(\d+)»* *([а-яА-ЯёЁ]+) (\d+)', 3) AS int) BETWEEN 1980 AND 2099, false) AS worded
FROM w LEFT JOIN best USING (word)""")
def levenshtein_month(spark: SparkSession, d: str) -> DataFrame:
    """STR-08, STR-09, MAT-19."""
    return table(spark, d, "acts").where("start_date is not null").select("id", text.date_to_dots(F.col("start_date")).alias("dots"), text.is_worded_date(F.col("start_date")).alias("worded")).distinct()


@query(r"""SELECT DISTINCT id, trim(regexp_extract(document, '^(\D+?) от ', 1)) AS order_name, regexp_extract(document, '(№\s+\d+-*\d*)', 1) AS order_number, regexp_extract(document, '(\d{2}\.\d{2}\.\d{4})', 1) AS order_date FROM archaeological_heritage_sites WHERE document IS NOT NULL""")
def order_citation_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archaeological_heritage_sites").where("document is not null").select("id", *[c.alias(n) for n, c in text.citation(F.col("document")).items()]).distinct()


_MADE_NAME = "coalesce(finish_date, '') || ' ' || coalesce(expert, '') || ', ' || coalesce(place, '') || ' НПД.pdf'"


@query(rf"""SELECT DISTINCT id, d AS file_date, regexp_extract(d, '(\d{{4}})', 1) AS file_year, trim(regexp_extract(stem, '\d{{1,2}}\.\d{{1,2}}\.\d{{4}}\s+([^,]+),', 1)) AS file_expert, trim(regexp_extract(stem, ',\s*(.+)$', 1)) AS file_place,
CASE WHEN contains(upper(stem), 'ЗУ') THEN 'ЗУ' WHEN contains(upper(stem), 'НПД') THEN 'НПД' ELSE '' END AS file_kind
FROM (SELECT id, stem, regexp_extract(stem, '(\d{{1,2}}\.\d{{1,2}}\.\d{{4}})', 1) AS d FROM (SELECT id, regexp_replace(regexp_replace({_MADE_NAME}, '^.*/', ''), '(?i)\.[a-zа-я0-9]{{2,4}}$', '') AS stem FROM acts WHERE NOT contains({_MADE_NAME}, chr(10))))""")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    name = F.concat(blank("finish_date"), F.lit(" "), blank("expert"), F.lit(", "), blank("place"), F.lit(" НПД.pdf"))
    named = table(spark, d, "acts").select("id", name.alias("name")).where(~F.contains("name", F.lit("\n")))
    return named.select("id", *[c.alias(n) for n, c in text.file_parts(F.col("name")).items()]).distinct()


@query(r"""SELECT DISTINCT id, trim(regexp_replace(name_number, '[^a-zA-Zа-яА-Я0-9 \-,«».()]', '', 'g'), ' .') AS component,
CASE WHEN length(s) > 40 THEN rtrim(substr(s, 1, 40), ' ._') ELSE s END AS file_name
FROM (SELECT id, name_number, regexp_replace(regexp_replace(translate(name_number, '<>:"/\|?*', '_________'), '\s+', ' ', 'g'), '_+', '_', 'g') AS s FROM acts WHERE name_number IS NOT NULL)""")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, STR-02."""
    return table(spark, d, "acts").where("name_number is not null").select("id", text.path_component(F.col("name_number")).alias("component"), text.file_name(F.col("name_number"), 40).alias("file_name")).distinct()


@query(r"SELECT doc_id, array_to_string(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+')[1:400], ' ') AS head FROM documents")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_words(F.col("text")).alias("head"))


@query()
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """STR-05 over all documents."""
    return extraction.chunks(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT doc_id, true AS fits, true AS in_place FROM documents WHERE regexp_matches(text, '\S')")
def chunks_checked(spark: SparkSession, d: str) -> DataFrame:
    """STR-05: every chunk is within its size and stands in its text where it says."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = extraction.chunks(docs, "doc_id", "text").join(docs, "doc_id")
    there = F.substring("text", F.col("start_index") + 1, F.length("chunk")) == F.col("chunk")
    return chunks.groupBy("doc_id").agg(F.bool_and(F.length("chunk").between(1, 750)).alias("fits"), F.bool_and(there).alias("in_place"))


@query("""SELECT DISTINCT id, replace(replace(upper(open_list), 'О', '0'), 'З', '3') AS list_number, translate(open_list, '/!|Г[ОЗбБ', '111110366') AS digits FROM acts WHERE open_list IS NOT NULL AND NOT contains(open_list, '()')""")
def scanner_confusions(spark: SparkSession, d: str) -> DataFrame:
    """STR-21."""
    return table(spark, d, "acts").where("open_list is not null").where(~F.contains("open_list", F.lit("()"))).select("id", text.scanned_list_number(F.col("open_list")).alias("list_number"), text.scanned_number(F.col("open_list")).alias("digits")).distinct()


@query(r"SELECT id, regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$') IS TRUE AS good FROM users")
def email_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "users").select("id", text.is_email(F.col("email")).alias("good"))


@query(r"""SELECT DISTINCT id, regexp_extract(name, '(?i)отч[её]т\s+об?\s+(\pL+)', 1) AS work, trim(regexp_extract(name, '(?i)\s(?:у|на|в)\s+(.+?)(?:,\s*\d{4})?\s*$', 1)) AS object, regexp_extract(name, '(\d{4})\D*$', 1) AS title_year FROM scientific_reports WHERE name IS NOT NULL""")
def title_page(spark: SparkSession, d: str) -> DataFrame:
    """STR-17."""
    return table(spark, d, "scientific_reports").where("name is not null").select("id", *[c.alias(n) for n, c in extraction.title_parts(F.col("name")).items()]).distinct()


@query(r"""SELECT DISTINCT id, CASE WHEN contains(lower(name_number), 'заключение') THEN 'заключение' WHEN contains(lower(name_number), 'акт') THEN 'акт' ELSE '' END AS act_kind, regexp_extract(name_number, '№\s*(\d+[-/]\d+)', 1) AS act_number, trim(regexp_extract(name_number, '«(.+)»', 1)) AS act_object FROM acts WHERE name_number IS NOT NULL""")
def act_names(spark: SparkSession, d: str) -> DataFrame:
    """STR-14."""
    return table(spark, d, "acts").where("name_number is not null").select("id", *[c.alias(n) for n, c in extraction.act_parts(F.col("name_number")).items()]).distinct()


@query(r"""SELECT DISTINCT id, try_cast(replace(replace(nullif(regexp_extract(conclusion, '(?is)площад[\pL\pN_]*.{0,80}?(\d+(?: \d{3})*(?:,\d+)?)\s+(га|кв\. м)', 1), ''), ' ', ''), ',', '.') AS double) AS area, nullif(regexp_extract(conclusion, '(?is)площад[\pL\pN_]*.{0,80}?(\d+(?: \d{3})*(?:,\d+)?)\s+(га|кв\. м)', 2), '') AS area_unit
FROM acts WHERE conclusion IS NOT NULL""")
def stated_areas(spark: SparkSession, d: str) -> DataFrame:
    """STR-13."""
    parts = text.measured(F.col("conclusion"))
    return table(spark, d, "acts").where("conclusion is not null").select("id", parts["area"].alias("area"), parts["area_unit"].alias("area_unit")).distinct()


def _act_pages(spark: SparkSession, d: str) -> DataFrame:
    """Acts put together as three pages with headings."""
    acts = table(spark, d, "acts").dropDuplicates(["id"])
    head = F.concat(F.lit("Акт\nДата начала экспертизы: "), F.coalesce("start_date", F.lit("")), F.lit("\nДата окончания экспертизы: "), F.coalesce("finish_date", F.lit("")), F.lit("\n4. Место проведения экспертизы: "), F.coalesce("place", F.lit("")))
    body = F.concat(F.lit("Сведения о проведенных исследованиях:\n"), F.coalesce("exp_info", F.lit("")), F.lit("\nФакты и сведения, выявленные в результате исследований:\n"), F.coalesce("exp_facts", F.lit("")))
    tail = F.concat(F.lit("Вывод экспертизы:\n"), F.coalesce("conclusion", F.lit("")))
    return acts.select(F.col("id").alias("doc_id"), F.posexplode(F.array(head, body, tail)).alias("page_no", "text"))


@query(" UNION ALL ".join(f"SELECT DISTINCT id AS doc_id, {k} AS pos, '{name}' AS section, trim(coalesce({field}, ''), ' :' || chr(10)) AS body FROM acts" for k, (name, field) in enumerate((("start_date", "start_date"), ("end_date", "finish_date"), ("place", "place"), ("research", "exp_info"), ("facts", "exp_facts"), ("conclusion", "conclusion")))))
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """STR-11, AGG-09: acts put together as pages with headings, taken apart again."""
    return extraction.sections(_act_pages(spark, d))


@query(r"SELECT DISTINCT id AS doc_id, trim(regexp_replace(regexp_replace(trim(coalesce(place, ''), ' :' || chr(10)), '[–:]', '', 'g'), '\s+', ' ', 'g')) AS place FROM acts")
def act_places(spark: SparkSession, d: str) -> DataFrame:
    """STR-14, UDF-09: places out of the sections of acts put together as pages."""
    return extraction.act_fields(extraction.sections(_act_pages(spark, d))).select("doc_id", "place")


@query(r"""WITH items AS (SELECT doc_id, text AS title, url || '/upload/' || coalesce(doc_type, 'x') || CASE WHEN doc_id % 7 = 0 THEN '.png' ELSE '.pdf' END AS href FROM documents),
x AS (SELECT *, regexp_extract(title, '(\d{2}\.\d{2}\.\d{4})', 1) AS dt, regexp_extract(href, '([^/]*)$', 1) AS file_name, lower(title || ' ' || href) AS low FROM items),
y AS (SELECT *, try_strptime(dt, '%d.%m.%Y')::date AS day FROM x)
SELECT doc_id, file_name, coalesce(r, 'Добавлен в очередь скачивания') AS reason, CASE WHEN r IS NULL THEN 'в очереди на скачивание' ELSE 'пропущен' END AS status FROM (SELECT doc_id, file_name,
CASE WHEN contains(title, 'Впервые сведения') OR contains(title, 'The inventory lists') THEN 'Исключение по фильтру' WHEN dt = '' THEN 'Не подходит по дате (дата не найдена)' WHEN day IS NULL THEN 'Ошибка парсинга даты' WHEN NOT (day BETWEEN DATE '2012-01-01' AND DATE '2022-12-31') THEN 'Не подходит по дате'
WHEN NOT contains(href, '/upload/') THEN 'Не найдена подходящая ссылка' WHEN NOT (contains(low, 'акт') OR contains(low, 'гикэ')) THEN 'Не является актом ГИКЭ' WHEN file_name = 'letter.pdf' THEN 'Файл уже скачан' WHEN regexp_matches(file_name, '\.(sig|png|jpg|bmp|tiff)$') THEN 'У файла неподходящий формат' END AS r FROM y)""")
def status_cascade(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14..17: documents as the items of a crawl."""
    href = F.concat("url", F.lit("/upload/"), F.coalesce("doc_type", F.lit("x")), F.when(F.col("doc_id") % 7 == 0, ".png").otherwise(".pdf"))
    items = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"), href.alias("href"))
    known = spark.range(1).select(F.lit("letter.pdf").alias("file_name"))
    return sources.status_cascade(items, known, ["Впервые сведения", "The inventory lists"], "2012-01-01", "2022-12-31").select("doc_id", "file_name", "reason", "status")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'скачан') AS downloaded, count(*) FILTER (WHERE status = 'пропущен') AS skipped, count(*) FILTER (WHERE status = 'в очереди на скачивание') AS queued, count(*) FILTER (WHERE status = 'ошибка') AS failed FROM ({SQL['status_cascade']})")
def crawl_report(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03 over the cascade."""
    return sinks.status_counts(status_cascade(spark, d))


# --- geography -------------------------------------------------------------------------------------------------------

POINTS = """(SELECT DISTINCT c.id, g.key AS grp, json_extract_string(g.value, '$.coordinate_system') AS coord_system, p.key AS point_name, cast(json_extract(p.value, '$[0]') AS double) AS lat, cast(json_extract(p.value, '$[1]') AS double) AS lon
FROM object_account_cards c, json_each(c.coordinates) g, json_each(g.value) p WHERE p.key NOT IN ('coordinate_system', 'area') AND json_array_length(p.value) = 2)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return register.coordinate_points(table(spark, d, "object_account_cards").dropDuplicates(["id"]), "id")


@query(f"SELECT id, grp, coord_system, point_name, lat, lon FROM {POINTS}")
def json_flatten_points(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", "grp", "coord_system", "point_name", "lat", "lon")


@query(f"SELECT id, point_name, CASE WHEN lat BETWEEN 50 AND 60 AND lon >= 76.5 AND lon < 106.5 THEN 'мск' || cast(floor((lon - 76.5) / 3) + 162 AS int) WHEN lon >= 78 AND lon < 114 THEN 'мск24зона' || cast(floor((lon - 78) / 6) + 1 AS int) ELSE 'wgs84' END AS zone FROM {POINTS}")
def zone_select(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", "point_name", geo.zone(F.col("lat"), F.col("lon")).alias("zone"))


@query(f"""WITH p AS (SELECT *, cast(point_name AS int) AS pos FROM {POINTS}), f AS (SELECT *, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY id, grp ORDER BY pos)),
xy AS (SELECT *, (lon - lon0) / 360 * 2 * pi() * 6378137 * cos(radians(lat)) AS x, (lat - lat0) / 360 * 2 * pi() * 6378137 AS y FROM f), e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY id, grp) AS n FROM xy WINDOW w AS (PARTITION BY id, grp ORDER BY pos))
SELECT id, grp, round(CASE WHEN max(n) < 3 THEN 0.0 ELSE sum(coalesce(y * x2 - x * y2, 0)) / 2 END, 2) AS area FROM e GROUP BY id, grp""")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    """GEO-06, AGG-06, AGG-18."""
    return register.rings(_points(spark, d), "id").select("id", "grp", F.round(geo.ring_area(F.col("ring")), 2).alias("area"))


@query(f"""WITH p AS (SELECT *, cast(point_name AS int) AS pos FROM {POINTS}), e AS (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS lat2, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS lon2, count(*) OVER (PARTITION BY id, grp) AS n FROM p WINDOW w AS (PARTITION BY id, grp ORDER BY pos)),
c AS (SELECT id, avg(lat) AS lat, avg(lon) AS lon FROM p GROUP BY id)
SELECT c.id AS point_id, e.id AS polygon_id FROM c JOIN e ON e.n > 2 GROUP BY c.id, e.id, e.grp, c.lat, c.lon HAVING sum(CASE WHEN (e.lat > c.lat) <> (e.lat2 > c.lat) AND c.lon < (e.lon2 - e.lon) * (c.lat - e.lat) / (e.lat2 - e.lat) + e.lon THEN 1 ELSE 0 END) % 2 = 1""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """GEO-13: centres of the cards' coordinates in the cards' polygons."""
    points = _points(spark, d)
    polygons = register.rings(points, "id").select(F.col("id").alias("polygon_id"), "ring")
    centres = points.groupBy(F.col("id").alias("point_id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return spatial.points_in_polygons(centres, polygons)


#: SQL of the cards' shapes as segments, and of what is asked of two segments x and y.
SIDES = f"""r AS (SELECT *, count(*) OVER (PARTITION BY id, grp) AS n, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0
  FROM (SELECT *, cast(point_name AS int) AS pos FROM {POINTS}) WINDOW w AS (PARTITION BY id, grp ORDER BY pos)),
s AS (SELECT id, grp, n, pos, lat AS a, lon AS b, CASE WHEN n = 1 THEN lat ELSE coalesce(lat2, lat0) END AS c, CASE WHEN n = 1 THEN lon ELSE coalesce(lon2, lon0) END AS d FROM r WHERE NOT (n = 2 AND lat2 IS NULL)),
i AS (SELECT f.id AS inner_id, s.id AS outer_id FROM (SELECT id, lat, lon FROM r QUALIFY row_number() OVER (PARTITION BY id, grp ORDER BY pos) = 1) f JOIN s ON s.n > 2 AND s.id <> f.id
  GROUP BY f.id, f.lat, f.lon, s.id, s.grp HAVING sum(CASE WHEN (s.a > f.lat) <> (s.c > f.lat) AND f.lon < (s.d - s.b) * (f.lat - s.a) / (s.c - s.a) + s.b THEN 1 ELSE 0 END) % 2 = 1)"""


def _turned(a: str, b: str, c: str) -> str:
    return f"(({c[1]} - {a[1]}) * ({b[0]} - {a[0]}) > ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def _sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


_X, _Y = (("x.a", "x.b"), ("x.c", "x.d")), (("y.a", "y.b"), ("y.c", "y.d"))
_CROSSED = f"({_turned(_X[0], _Y[0], _Y[1])} <> {_turned(_X[1], _Y[0], _Y[1])} AND {_turned(_X[0], _X[1], _Y[0])} <> {_turned(_X[0], _X[1], _Y[1])})"


def _sql_place(p: tuple[str, str], s: tuple[tuple[str, str], tuple[str, str]], shrink: str) -> tuple[str, str]:
    """Latitude and longitude of the place of segment s nearest to p, on the plane with longitudes shrunk."""
    dy, dx = f"({s[1][0]} - {s[0][0]})", f"(({s[1][1]} - {s[0][1]}) * {shrink})"
    size = f"({dy} * {dy} + {dx} * {dx})"
    t = f"CASE WHEN {size} > 0 THEN greatest(0.0, least(1.0, (({p[0]} - {s[0][0]}) * {dy} + ({p[1]} - {s[0][1]}) * {shrink} * {dx}) / {size})) ELSE 0.0 END"
    return f"({s[0][0]} + ({t}) * ({s[1][0]} - {s[0][0]}))", f"({s[0][1]} + ({t}) * ({s[1][1]} - {s[0][1]}))"


_ENDS = ((_X[0], _Y), (_X[1], _Y), (_Y[0], _X), (_Y[1], _X))
_LEAST_KM = "least(" + ", ".join(_sql_km(*p, *_sql_place(p, s, "cos(radians((x.a + y.a) / 2))")) for p, s in _ENDS) + ")"


def _card_shapes(spark: SparkSession, d: str) -> DataFrame:
    return register.rings(_points(spark, d), "id").select("id", "ring")


@query(f"""WITH {SIDES}, m AS (SELECT x.id AS shape_id, y.id AS target_id, round(CASE WHEN {_CROSSED} THEN 0.0 ELSE {_LEAST_KM} END, 6) AS km FROM s x JOIN s y ON x.id <> y.id
UNION ALL SELECT inner_id, outer_id, 0.0 FROM i UNION ALL SELECT outer_id, inner_id, 0.0 FROM i)
SELECT shape_id, arg_min(target_id, (km, target_id)) AS target_id, min(km) AS km FROM m GROUP BY shape_id""")
def nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    """GEO-14, AGG-05: the nearest other card of each card, shape to shape, however far."""
    shapes = _card_shapes(spark, d)
    return spatial.nearest(shapes.withColumnRenamed("id", "shape_id"), shapes.withColumnRenamed("id", "target_id"))


_PLACES = " UNION ALL ".join(f"SELECT y.id, y.grp, x.grp AS own, pow({p[0]} - {q[0]}, 2) + pow({p[1]} - {q[1]}, 2) AS far, {p[0]} AS y1, {p[1]} AS x1, {q[0]} AS y2, {q[1]} AS x2, {_CROSSED} AS crossed FROM o x JOIN s y ON y.id <> x.id" for p, q in ((p, _sql_place(p, s, "1.0")) for p, s in _ENDS))


@query(f"""WITH {SIDES}, o AS (SELECT * FROM s WHERE id = (SELECT min(id) FROM s)), m AS ({_PLACES}),
k AS (SELECT id, grp, own, bool_or(crossed) AS crossed, arg_min({_sql_km('y1', 'x1', 'y2', 'x2')}, (far, y1, x1, y2, x2)) AS km FROM m GROUP BY id, grp, own)
SELECT id AS card_id, round(min(km), 6) AS km FROM (SELECT id, CASE WHEN crossed THEN 0.0 ELSE km END AS km FROM k
UNION ALL SELECT inner_id, 0.0 FROM i WHERE outer_id = (SELECT min(id) FROM s) UNION ALL SELECT outer_id, 0.0 FROM i WHERE inner_id = (SELECT min(id) FROM s)) GROUP BY id""")
def proximity_report(spark: SparkSession, d: str) -> DataFrame:
    """GEO-14, SRT-02: the distance of every other card to the first, which stands for an offer, the nearest first."""
    shapes = _card_shapes(spark, d)
    offer = shapes.join(F.broadcast(shapes.agg(F.min("id").alias("id"))), "id", "left_semi").select("ring")
    cards = shapes.join(F.broadcast(shapes.agg(F.min("id").alias("id"))), "id", "left_anti").withColumnRenamed("id", "card_id")
    return spatial.proximity(offer, cards).orderBy("km", "card_id")


@query()
def geodesic_perimeters(spark: SparkSession, d: str) -> DataFrame:
    """GEO-14: lengths of the catalogues' edges on the ellipsoid."""
    w = Window.partitionBy("id", "grp").orderBy("pos")
    edges = _points(spark, d).select("id", "grp", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null")
    return edges.withColumn("km", geo.geodesic(*[F.col(c) for c in ("lat", "lon", "lat2", "lon2")])).groupBy("id", "grp").agg(F.round(F.sum("km"), 6).alias("km"))


@query()
def regional_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """GEO-04, GEO-05: points in metres of their regional system."""
    placed = _points(spark, d).withColumn("zone", geo.zone(F.col("lat"), F.col("lon"))).withColumn("p", geo.projected(F.col("lat"), F.col("lon"), F.col("zone")))
    return placed.select("id", "point_name", "zone", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(f"SELECT id, point_name, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM {POINTS}")
def web_mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    return _points(spark, d).select("id", "point_name", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))




@query("SELECT n_nationkey, round((40 + n_nationkey + n_nationkey * 2 / 60.0 + (n_nationkey + 0.25) / 3600.0) * CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE 1 END, 9) AS degrees FROM nation")
def dms_parse(spark: SparkSession, d: str) -> DataFrame:
    """GEO-01..03 on coordinates made of nation keys."""
    k = F.col("n_nationkey")
    made = F.concat((k + 40).cast("string"), F.lit("°"), (k * 2).cast("string"), F.lit("'"), (k + F.lit(0.25)).cast("string"), F.lit('"'), F.when(k % 3 == 0, "S").otherwise("N"))
    return table(spark, d, "nation").select("n_nationkey", F.round(geo.dms(made), 9).alias("degrees"))


@query("""WITH q AS (SELECT o_orderkey, o_orderkey % 7 AS ax, o_orderkey % 5 AS ay, o_orderkey % 11 AS bx, o_orderkey % 13 AS by_, o_custkey % 7 AS cx, o_custkey % 5 AS cy, o_custkey % 11 AS dx, o_custkey % 13 AS dy FROM orders),
t AS (SELECT o_orderkey, ((dy - ay) * (cx - ax) > (cy - ay) * (dx - ax)) AS acd, ((dy - by_) * (cx - bx) > (cy - by_) * (dx - bx)) AS bcd, ((cy - ay) * (bx - ax) > (by_ - ay) * (cx - ax)) AS abc, ((dy - ay) * (bx - ax) > (by_ - ay) * (dx - ax)) AS abd FROM q)
SELECT o_orderkey, acd <> bcd AND abc <> abd AS crossed FROM t""")
def segment_intersect(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", geo.crosses((o % 7, o % 5), (o % 11, o % 13), (c % 7, c % 5), (c % 11, c % 13)).alias("crossed"))


@query("SELECT DISTINCT id, grp, CASE WHEN contains(grp, 'фотофиксации') THEN 'photos' WHEN contains(grp, 'Каталог') THEN 'catalog' WHEN contains(grp, 'Шурфы') THEN 'pits' WHEN contains(grp, 'Центр') THEN 'center' END AS style FROM (SELECT c.id, g.key AS grp FROM object_account_cards c, json_each(c.coordinates) g)")
def group_styles(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-10."""
    cards = table(spark, d, "object_account_cards").select("id", F.explode(F.map_keys(F.from_json("coordinates", "map<string,string>"))).alias("grp"))
    return cards.select("id", "grp", register.group_style(F.col("grp")).alias("style")).distinct()


@query("SELECT DISTINCT id, 'https://archive.example/acts/' || id || '/' AS url, coalesce(json_extract_string(source, '$[0].origin_filename'), name_number) AS shown FROM acts")
def object_names(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05, PRJ-08."""
    return table(spark, d, "acts").select("id", register.object_url("https://archive.example", F.lit("act"), F.col("id")).alias("url"), F.coalesce(F.get_json_object("source", "$[0].origin_filename"), "name_number").alias("shown")).distinct()


# --- layout, sets, changes, vectors, streams -------------------------------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS block_id, l_partkey % 100 AS y1, l_partkey % 100 + l_quantity AS y2, l_suppkey % 50 AS x1, l_suppkey % 50 + 10 AS x2 FROM lineitem),
h AS (SELECT o_orderkey AS page, s AS section, (o_custkey * s) % 120 AS y1, (o_custkey * s) % 120 + 15 AS y2, 20 * s AS x1, 20 * s + 10 AS x2 FROM orders, (VALUES (1), (2)) v(s)),
c AS (SELECT b.page, b.block_id, h.section, CASE WHEN NOT (h.y2 < b.y1 OR h.y1 > b.y2) THEN 0 WHEN b.y1 - h.y2 BETWEEN 0 AND 200 THEN 1 END AS k, CASE WHEN NOT (h.y2 < b.y1 OR h.y1 > b.y2) THEN greatest(0, h.x1 - b.x2, b.x1 - h.x2) ELSE b.y1 - h.y2 END AS dist FROM b LEFT JOIN h USING (page))
SELECT page, block_id, coalesce(arg_min(cast(section AS varchar), (k, dist, cast(section AS varchar))) FILTER (WHERE k IS NOT NULL), 'UNKNOWN') AS section FROM c GROUP BY page, block_id""")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """JOI-09 on boxes made of orders and their lines."""
    line = table(spark, d, "lineitem")
    y, x = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    blocks = line.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_id"), y.alias("y1"), (y + F.col("l_quantity")).alias("y2"), x.alias("x1"), (x + 10).alias("x2"))
    heads = table(spark, d, "orders").withColumn("s", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("y", (F.col("o_custkey") * F.col("s")) % 120)
    heads = heads.select(F.col("o_orderkey").alias("page"), F.col("s").cast("string").alias("section"), F.col("y").alias("y1"), (F.col("y") + 15).alias("y2"), (20 * F.col("s")).alias("x1"), (20 * F.col("s") + 10).alias("x2"))
    return layout.sections_of_blocks(blocks, heads)


@query("""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderkey % 3 AS first, o_orderkey % 3 + 1 AS last FROM orders), l AS (SELECT *, CASE WHEN first = lag(last) OVER (PARTITION BY doc ORDER BY page, first) + 1 THEN 0 ELSE 1 END AS fresh FROM t)
SELECT doc, page, sum(fresh) OVER (PARTITION BY doc ORDER BY page, first ROWS UNBOUNDED PRECEDING) AS run FROM l""")
def table_continuation(spark: SparkSession, d: str) -> DataFrame:
    """JOI-11 on tables made of orders."""
    k = F.col("o_orderkey")
    tables = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), k.alias("page"), (k % 3).alias("first"), (k % 3 + 1).alias("last"))
    return layout.continued_tables(tables, "doc", "page", "first", "last").select("doc", "page", "run")


@query("""SELECT page, line_y, string_agg(word, ' ' ORDER BY x1, word) AS text, min(x1) AS x1, max(x2) AS x2 FROM (SELECT l_orderkey AS page, cast(round_even(l_partkey % 100 / 20.0, 0) AS int) * 20 AS line_y, l_suppkey % 50 AS x1, l_suppkey % 50 + 5 AS x2, l_returnflag || l_linenumber AS word FROM lineitem) GROUP BY page, line_y""")
def line_grouping(spark: SparkSession, d: str) -> DataFrame:
    """SRT-04, AGG-15."""
    y, x = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), x.alias("x1"), (x + 5).alias("x2"), y.alias("y1"), (y + 3).alias("y2"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("word"))
    return layout.text_lines(words).select("page", "line_y", "text", "x1", "x2")


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def best_box_per_class(spark: SparkSession, d: str) -> DataFrame:
    """LIM-06."""
    return layout.best_boxes(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("SELECT DISTINCT id, CASE WHEN type IN ('гикэ', 'ГИКЭ') THEN 'акт' ELSE type END AS type, CASE WHEN user_id IN (SELECT id FROM users WHERE is_superuser) THEN NULL ELSE user_id END AS user_id FROM acts WHERE NOT (year IS NOT NULL AND trim(year) = '')")
def stored_changes(spark: SparkSession, d: str) -> DataFrame:
    """DML-01, DML-02, DML-05: update, delete and set-null as new versions."""
    kept = changes.deleted(table(spark, d, "acts"), F.trim("year") == "")
    renamed = changes.updated(kept, F.col("type").isin("гикэ", "ГИКЭ"), {"type": F.lit("акт")})
    return changes.nulled(renamed, table(spark, d, "users").where("is_superuser"), "user_id", "id").select("id", "type", "user_id").distinct()


@query("SELECT id, 'site' AS kind, doc_name AS name FROM archaeological_heritage_sites UNION ALL SELECT id, 'identified', name FROM identified_archaeological_heritage_sites")
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    """SET-02, SET-05, PRJ-06."""
    sites = table(spark, d, "archaeological_heritage_sites").select("id", F.lit("site").alias("kind"), F.col("doc_name").alias("name"))
    return sites.unionByName(table(spark, d, "identified_archaeological_heritage_sites").select("id", F.lit("identified").alias("kind"), "name"))


@query("SELECT type, count(*) AS n FROM acts WHERE place LIKE '%район%' GROUP BY type")
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21, STR-26."""
    table(spark, d, "acts").createOrReplaceTempView("acts")
    return retrieval.run_sql(spark, "SELECT type, count(*) AS n FROM acts WHERE place LIKE '%район%' GROUP BY type")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT e.vec_id, q.query_id, round(list_dot_product(e.embedding::double[], q.v::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]) * list_dot_product(q.v::double[], q.v::double[])), 9) AS score FROM embeddings e, q)
SELECT vec_id, query_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """RET-02: every row whose id is divisible by 100 asks all rows."""
    vectors = table(spark, d, "embeddings")
    asking = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.top_k(vectors, asking, "vec_id", "embedding").select("vec_id", "query_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An addition of this engine: tumbling windows, the same on a stream."""
    return crawl.windowed(table(spark, d, "events"))


# --- smaller predicates and aggregates -------------------------------------------------------------------------------


@query("SELECT id, email FROM users u WHERE email IS NOT NULL AND EXISTS (SELECT 1 FROM users v WHERE v.email = u.email AND v.id <> u.id)")
def taken_values(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13."""
    users = table(spark, d, "users")
    return predicates.taken(users, "id", users.select("id", "email"), "email")


@query(f"SELECT id, username FROM {ONE_ACT} a WHERE user_id = 5 OR (SELECT is_superuser FROM users WHERE id = 5)")
def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT-21."""
    return predicates.owned(_acts(spark, d).drop("is_superuser"), table(spark, d, "users"), 5).select("id", "username").distinct()


@query(f"SELECT id, grp, point_name FROM {POINTS} WHERE id || '-' || point_name IN (SELECT DISTINCT id || '-1' FROM object_account_cards WHERE id % 3 = 0)")
def selected_points(spark: SparkSession, d: str) -> DataFrame:
    """FLT-18, FLT-19."""
    chosen = table(spark, d, "object_account_cards").where("id % 3 = 0").select(F.concat(F.col("id").cast("string"), F.lit("-1")).alias("key"))
    return predicates.selected(_points(spark, d), ["id", "point_name"], chosen).select("id", "grp", "point_name")


@query(f"""WITH f AS (SELECT DISTINCT path FROM {FILES} WHERE path LIKE 'uploaded_files/%'), n AS (SELECT *, count(*) FILTER (WHERE lower(path) LIKE '%.pdf') OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '')) AS k FROM f)
SELECT path FROM n WHERE len(string_split(substr(path, 16), '/')) <= 2 OR k > 1""")
def files_to_reorganise(spark: SparkSession, d: str) -> DataFrame:
    """FLT-20, FLT-24."""
    files = matching.files_of(table(spark, d, "acts"), "id").select("path").where("path is not null").distinct()
    return predicates.needs_reorganising(files, "uploaded_files").select("path")


@query(f"""WITH z AS (SELECT id, grp, CASE WHEN lat BETWEEN 50 AND 60 AND lon >= 76.5 AND lon < 106.5 THEN 'мск' || cast(floor((lon - 76.5) / 3) + 162 AS int) WHEN lon >= 78 AND lon < 114 THEN 'мск24зона' || cast(floor((lon - 78) / 6) + 1 AS int) ELSE 'wgs84' END AS zone FROM {POINTS})
SELECT id, grp, CASE WHEN min(zone) = max(zone) THEN min(zone) ELSE 'wgs84' END AS zone FROM z GROUP BY id, grp""")
def zone_agreement(spark: SparkSession, d: str) -> DataFrame:
    """AGG-07."""
    return predicates.agreed_zone(_points(spark, d).withColumn("zone", geo.zone(F.col("lat"), F.col("lon"))), ["id", "grp"], "zone")


@query("SELECT user_id, list(event_type ORDER BY first_at, event_type) AS \"values\" FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL) GROUP BY user_id")
def first_seen_values(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11."""
    return predicates.first_seen(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT o_orderkey, abs(sum(l_extendedprice) - max(o_totalprice)) <= 0.5 * greatest(abs(sum(l_extendedprice)), abs(max(o_totalprice))) AS agrees FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def parts_add_up(spark: SparkSession, d: str) -> DataFrame:
    """AGG-08 on order lines, with a wide tolerance."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_extendedprice")).alias("parts"))
    return table(spark, d, "orders").join(lines, "o_orderkey").select("o_orderkey", predicates.adds_up(F.col("parts"), F.col("o_totalprice"), 0.5).alias("agrees"))


@query("SELECT l_orderkey, l_linenumber, cast(floor(l_suppkey % 50 / 50.0 * 2) + 2 * floor(l_partkey % 90 / 90.0 * 9) AS int) AS cell FROM lineitem")
def tick_cells(spark: SparkSession, d: str) -> DataFrame:
    """UDF-07's binning of tick marks."""
    x, y = F.col("l_suppkey") % 50, F.col("l_partkey") % 90
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", predicates.tick_cell(x, y, F.lit(50.0), F.lit(90.0), 2, 9).alias("cell"))


@query("""SELECT DISTINCT 'act' AS report_type, id, coalesce(json_extract_string(source, '$[0].origin_filename'), 'Акт №' || id) AS shown FROM acts WHERE NOT coalesce(is_processing, false)
UNION ALL SELECT DISTINCT 'report', id, coalesce(json_extract_string(source, '$[0].origin_filename'), 'Отчёт №' || id) FROM scientific_reports WHERE NOT coalesce(is_processing, false)
UNION ALL SELECT DISTINCT 'card', id, 'Карта №' || id FROM object_account_cards WHERE NOT coalesce(is_processing, false)""")
def reports_on_map(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05, PRJ-06: all finished reports of three kinds, tagged and named."""
    kinds = {"act": ("acts", "Акт"), "report": ("scientific_reports", "Отчёт"), "card": ("object_account_cards", "Карта")}
    return catalog.map_of_reports({kind: (table(spark, d, name), called) for kind, (name, called) in kinds.items()})


@query("SELECT doc_id, len(regexp_extract_all(text, '№\\s*\\d+')) AS citations, contains(text, chr(10) || chr(10)) AS parted, length(regexp_replace(text, chr(10) || '{2,}', chr(10), 'g')) AS n FROM documents")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    """STR-06, STR-28: collapsed blank lines and counted citations."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"№\s*\d+"), F.lit(0))).cast("long").alias("citations"), F.contains(t, F.lit("\n\n")).alias("parted"), F.length(text.collapse_blank_lines(t)).cast("long").alias("n"))


@query("SELECT DISTINCT id, CASE WHEN contains(f, 'текст') THEN 'text' WHEN contains(f, 'приложение') OR contains(f, 'иллюстрации') THEN 'images' ELSE 'all' END AS role FROM (SELECT id, lower(json_extract_string(source, '$[0].origin_filename')) AS f FROM scientific_reports)")
def file_roles(spark: SparkSession, d: str) -> DataFrame:
    """STR-23."""
    return table(spark, d, "scientific_reports").select("id", text.file_role(F.get_json_object("source", "$[0].origin_filename")).alias("role")).distinct()


@query("SELECT e.user_id, count(*) AS n, max(e.value) AS top FROM events e WHERE e.event_type IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = e.user_id AND u.is_superuser) GROUP BY e.user_id")
def in_list_and_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, SET-03."""
    kept = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return kept.join(table(spark, d, "users").where("is_superuser").select(F.col("id").alias("user_id")), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"SELECT id, count(*) AS marks, count(DISTINCT grp) AS folders, count(DISTINCT CASE WHEN contains(grp, 'Каталог') THEN grp END) AS polygons FROM {POINTS} WHERE contains(grp, 'Каталог') OR contains(grp, 'фотофиксации') OR contains(grp, 'Шурфы') OR contains(grp, 'Центр') GROUP BY id")
def kml_export(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03: the coordinates of each card as KML: its marks, folders and polygons."""
    told = kml.kml_text(_points(spark, d).withColumn("style", register.group_style(F.col("grp"))), "id")
    count = lambda pattern: F.size(F.regexp_extract_all("kml", F.lit(pattern), F.lit(0))).cast("long")
    return told.select("id", count("<Point>").alias("marks"), count("<Folder>").alias("folders"), count("<Polygon>").alias("polygons"))


@query()
def keyword_sections(spark: SparkSession, d: str) -> DataFrame:
    """MAT-17: the section a card's text belongs to by its best keyword."""
    keywords = {"finds": ["находки", "инвентарь"], "layer": ["слой", "суглинок"], "state": ["состояние", "повреждений"]}
    return table(spark, d, "object_account_cards").dropDuplicates(["id"]).select("id", similarity.best_keyword(F.col("description"), keywords).alias("section"))


# --- entities, grids, round trips -------------------------------------------------------------------------------------


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_account_cards")


@query("""SELECT DISTINCT c.id, c.name FROM object_account_cards c LEFT JOIN users u ON c.user_id = u.id WHERE contains(lower(c.name), 'го') AND contains(lower(c.address), 'район') AND contains(lower(u.username), 'user00') AND coalesce(c.is_public, false)""")
def card_named_filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, FLT-05 on the register of cards."""
    cards = _cards(spark, d).join(_users(spark, d), "user_id", "left")
    return catalog.named(cards, {"name": "ГО", "address": "район", "owner": "user00", "storage_type": "public", "unknown": "x", "usage": ""}).select("id", "name").distinct()


@query("SELECT DISTINCT id, name, author FROM scientific_reports WHERE contains(lower(author), 'ов') AND contains(lower(organization), 'о') AND NOT coalesce(is_public, false) AND user_id IN (SELECT min(user_id) FROM (SELECT user_id, count(*) AS n FROM scientific_reports GROUP BY user_id QUALIFY rank() OVER (ORDER BY n DESC) = 1))")
def report_named_filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, FLT-05 on the register of scientific reports: the private storage of the user with most reports."""
    reports = table(spark, d, "scientific_reports")
    most = reports.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max_by("user_id", F.struct("n", -F.col("user_id")))).first()[0]
    return catalog.named(reports, {"author": "ов", "organization": "О", "storage_type": "private"}, user_id=most).select("id", "name", "author").distinct()


@query("SELECT DISTINCT id, register_num FROM archaeological_heritage_sites WHERE contains(lower(district), 'район') AND account_card_id IS NULL AND NOT coalesce(is_excluded, false)")
def site_named_filters(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, FLT-06, FLT-07 on the register of sites."""
    return catalog.named(table(spark, d, "archaeological_heritage_sites"), {"district": "РАЙОН", "account_card_filter": "not_available", "show_excluded": False}).select("id", "register_num").distinct()


@query("SELECT DISTINCT id, account_card_id AS account_card, strftime(date_uploaded AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS date_uploaded, name, address, obj_info, document, is_excluded FROM identified_archaeological_heritage_sites")
def entity_shape(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-03: identified sites as they are served."""
    return catalog.shape(table(spark, d, "identified_archaeological_heritage_sites"), "identified_site").withColumn("date_uploaded", F.date_format("date_uploaded", "yyyy-MM-dd HH:mm:ss")).distinct()


@query("SELECT event_id AS id, e.event_type AS chat, cast(e.user_id AS varchar) AS sender, u.username AS sender_name, e.event_type AS content FROM events e LEFT JOIN users u ON u.id = e.user_id")
def message_senders(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-09: events as messages, the sender as stored beside the user's name."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("chat"), F.col("user_id").alias("sender"), F.col("event_type").alias("content"), F.col("ts").alias("sent_at"))
    return catalog.messages(rows, table(spark, d, "users")).drop("sent_at")


@query(f"""WITH f AS (SELECT DISTINCT id, path, regexp_replace(path, '/[^/]*$', '') AS dir FROM {FILES} WHERE path IS NOT NULL AND contains(path, '/'))
SELECT a.path, min(b.id) AS id FROM (SELECT DISTINCT path, dir FROM f) a JOIN f b ON a.dir = b.dir GROUP BY a.path""")
def card_of_folder(spark: SparkSession, d: str) -> DataFrame:
    """JOI-08: each file with the first act that has a file in its folder."""
    files = matching.files_of(table(spark, d, "acts"), "id").where(F.contains("path", F.lit("/")))
    return catalog.card_of_folder(files, files)


@query("SELECT DISTINCT id, CASE WHEN id % 5 = 0 THEN coalesce(json_array_length(source), 0) + 2 ELSE json_array_length(source) END AS files, CASE WHEN id % 5 = 0 THEN 'b' ELSE json_extract_string(source, '$[' || (json_array_length(source) - 1) || '].path') END AS last_path FROM acts")
def appended_files(spark: SparkSession, d: str) -> DataFrame:
    """DML-06: two files appended to the list of every fifth act."""
    acts = table(spark, d, "acts").select("id", "source").distinct()
    more = acts.where("id % 5 = 0").select("id", F.explode(F.array(F.lit('{"path": "a"}'), F.lit('{"path": "b"}'))).alias("element")).distinct()
    out = changes.appended(acts, "id", "source", more)
    files = F.from_json("source", "array<struct<path:string>>")
    return out.select("id", F.json_array_length("source").cast("long").alias("files"), F.element_at(files, -1)["path"].alias("last_path"))


@query("SELECT user_id, list_sort([e.key || '=' || e.value FOR e IN map_entries(m)]) AS merged FROM (SELECT user_id, map_from_entries(list((event_type, n))) AS m FROM (SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN -1 ELSE count(*) END AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id)")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """SET-06: each user's counts by type, the later map's clicks winning."""
    counted = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    one = lambda df, c: df.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(c))
    both = one(counted, "a").join(one(counted.where("event_type = 'click'").withColumn("n", F.lit(-1).cast("long")), "b"), "user_id", "left")
    entries = F.transform(F.map_entries(changes.merged(F.col("a"), F.col("b"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return both.select("user_id", F.sort_array(entries).alias("merged"))


@query(f"""WITH c AS (SELECT id, row_number() OVER (PARTITION BY id, grp ORDER BY cast(point_name AS int)) AS k, id || grp AS g, lat, lon FROM {POINTS}), q AS (SELECT g, max(lat) FILTER (k = 1) AS a1, max(lon) FILTER (k = 1) AS b1, max(lat) FILTER (k = 2) AS a2, max(lon) FILTER (k = 2) AS b2, max(lat) FILTER (k = 3) AS a3, max(lon) FILTER (k = 3) AS b3, max(lat) FILTER (k = 4) AS a4, max(lon) FILTER (k = 4) AS b4 FROM c GROUP BY g HAVING max(k) >= 4),
t AS (SELECT *, {_turned(('a1', 'b1'), ('a3', 'b3'), ('a4', 'b4'))} <> {_turned(('a2', 'b2'), ('a3', 'b3'), ('a4', 'b4'))} AND {_turned(('a1', 'b1'), ('a2', 'b2'), ('a3', 'b3'))} <> {_turned(('a1', 'b1'), ('a2', 'b2'), ('a4', 'b4'))} AS p, {_turned(('a2', 'b2'), ('a4', 'b4'), ('a1', 'b1'))} <> {_turned(('a3', 'b3'), ('a4', 'b4'), ('a1', 'b1'))} AND {_turned(('a2', 'b2'), ('a3', 'b3'), ('a4', 'b4'))} <> {_turned(('a2', 'b2'), ('a3', 'b3'), ('a1', 'b1'))} AS q FROM q)
SELECT g, CASE WHEN p OR q THEN a4 ELSE a3 END AS third, CASE WHEN p OR q THEN a3 ELSE a4 END AS fourth FROM t""")
def uncrossed_rings(spark: SparkSession, d: str) -> DataFrame:
    """GEO-12: the first four points of each ring, opposite sides uncrossed."""
    rings = register.rings(_points(spark, d), "id").where(F.size("ring") >= 4)
    done = rings.select(F.concat(F.col("id").cast("string"), "grp").alias("g"), geo.uncrossed(F.slice("ring", 1, 4)).alias("r"))
    return done.select("g", F.col("r")[2]["lat"].alias("third"), F.col("r")[3]["lat"].alias("fourth"))


@query(f"SELECT id, point_name, zone, round(lat, 7) AS lat, round(lon, 7) AS lon FROM (SELECT *, CASE WHEN lat BETWEEN 50 AND 60 AND lon >= 76.5 AND lon < 106.5 THEN 'мск' || cast(floor((lon - 76.5) / 3) + 162 AS int) WHEN lon >= 78 AND lon < 114 THEN 'мск24зона' || cast(floor((lon - 78) / 6) + 1 AS int) ELSE 'wgs84' END AS zone FROM {POINTS}) WHERE zone <> 'wgs84'")
def regional_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """GEO-04, GEO-05: points to metres of their regional system and back."""
    placed = _points(spark, d).withColumn("zone", geo.zone(F.col("lat"), F.col("lon"))).where("zone <> 'wgs84'").withColumn("p", geo.projected(F.col("lat"), F.col("lon"), F.col("zone")))
    back = placed.withColumn("w", geo.unprojected(F.col("p.x"), F.col("p.y"), F.col("zone")))
    return back.select("id", "point_name", "zone", F.round("w.lat", 7).alias("lat"), F.round("w.lon", 7).alias("lon"))


@query(f"""SELECT id, grp, count(*) - 1 AS edges, true AS near FROM {POINTS} GROUP BY id, grp HAVING count(*) > 1""")
def geodesic_against_sphere(spark: SparkSession, d: str) -> DataFrame:
    """GEO-14: edges on the ellipsoid are within six thousandths of those on the sphere."""
    w = Window.partitionBy("id", "grp").orderBy("pos")
    edges = _points(spark, d).select("id", "grp", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null")
    at = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    near = F.abs(geo.geodesic(*at) - geo.haversine(*at)) <= 0.006 * geo.haversine(*at) + 1e-9
    return edges.withColumn("near", near).groupBy("id", "grp").agg(F.count("*").alias("edges"), F.bool_and("near").alias("near"))


@query(f"""WITH p AS (SELECT *, CASE WHEN contains(grp, 'фотофиксации') THEN 'photos' WHEN contains(grp, 'Каталог') THEN 'catalog' WHEN contains(grp, 'Шурфы') THEN 'pits' WHEN contains(grp, 'Центр') THEN 'center' END AS style FROM {POINTS})
SELECT id, 'Point' AS kind, point_name AS name, round(lat, 7) AS lat, round(lon, 7) AS lon FROM p WHERE style IS NOT NULL
UNION ALL SELECT id, 'Polygon', 'Полигон', round(lat, 7), round(lon, 7) FROM p WHERE style = 'catalog'""")
def kml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03, SRC-11, SRC-12: the cards as KML with styles and closed rings, read again."""
    drawn = kml.kml_text(_points(spark, d).withColumn("style", register.group_style(F.col("grp"))), "id")
    marks = kml.placemarks_of(drawn, "id", "kml").select("id", "kind", "name", F.explode("coords").alias("c"), F.size("coords").alias("n"))
    return marks.select("id", "kind", "name", F.round("c.lat", 7).alias("lat"), F.round("c.lon", 7).alias("lon"))


@query(f"SELECT CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS marks, count(DISTINCT id) AS folders FROM {POINTS} WHERE contains(grp, 'Каталог') GROUP BY 1")
def kml_of_all(spark: SparkSession, d: str) -> DataFrame:
    """SNK-04: all cards' catalogues in one document for each kind, a folder for each card; counted."""
    points = _points(spark, d).where(F.contains("grp", F.lit("Каталог"))).withColumn("style", F.lit("catalog")).withColumn("kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    told = kml.kml_of_all(points, "kind", "id")
    count = lambda pattern: F.size(F.regexp_extract_all("kml", F.lit(pattern), F.lit(0))).cast("long")
    return told.select("kind", count("<Point>").alias("marks"), count(r"<Folder><name>\d+</name>").alias("folders"))


@query(f"SELECT id, 'Каталог координат [' || grp || ']' AS grp, 'wgs84' AS system, point_name, round(lat, 7) AS lat, round(lon, 7) AS lon FROM {POINTS}")
def grid_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """GEO-07, GEO-08, SRC-08: the cards' points as a sheet with a title, blank rows and a part named once, read again."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", "point_name", "lat", "lon"))), lambda p: F.array(F.lit(""), p["point_name"], F.replace(F.format_number(p["lat"], 7), F.lit("."), F.lit(",")), F.replace(F.format_number(p["lon"], 7), F.lit("."), F.lit(","))))
    held = _points(spark, d).groupBy("id", "grp").agg(rows.alias("rows"))
    first = F.transform("rows", lambda r, k: F.when(k == 0, F.concat(F.array("grp"), F.slice(r, 2, 3))).otherwise(r))
    head = F.array(F.array(F.lit("Участок"), F.lit("№"), F.lit("Северная широта"), F.lit("Восточная долгота")))
    blank = F.array(F.array(F.lit("Каталог"), F.lit(""), F.lit(""), F.lit("")), F.array(*[F.lit("")] * 4))
    sheets = held.select("id", "grp", F.concat(blank, head, first, blank).alias("cells")).withColumn("key", F.concat_ws("|", F.col("id").cast("string"), "grp"))
    tables = grids.sheet_tables(sheets, "key").withColumn("systems", F.lit("WGS-84"))
    return grids.table_points(tables, "key").select(F.split("key", r"\|")[0].cast("long").alias("id"), "grp", "system", "point_name", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(f"SELECT id, CASE WHEN k = 1 THEN 'Каталог координат' ELSE 'Шурфы' END AS grp, n AS point_no, round(lat, 7) AS lat, round(lon, 7) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY grp, pos) AS n FROM (SELECT *, cast(point_name AS int) AS pos, CASE WHEN cast(point_name AS int) % 2 = 1 THEN 1 ELSE 2 END AS k FROM {POINTS}))")
def text_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """GEO-10, GEO-02: the cards' points written into a page in degrees, minutes and seconds under two headings, read again."""

    def dms(v):
        whole = F.floor(F.round(v * 3600, 5) / 60)
        return F.concat(F.floor(whole / 60).cast("string"), F.lit("°"), (whole % 60).cast("string"), F.lit("'"), F.format_number(F.round(F.round(v * 3600, 5) - whole * 60, 5), 5), F.lit('"'))

    line = lambda p: F.concat(F.lit("точка N "), dms(p["lat"]), F.lit(" E "), dms(p["lon"]))
    points = F.sort_array(F.collect_list(F.struct("grp", "pos", "lat", "lon", "point_name")))
    odd = lambda p: p["point_name"].cast("int") % 2 == 1
    lines = lambda keep: F.array_join(F.transform(F.filter("p", keep), line), "\n")
    pages = _points(spark, d).groupBy("id").agg(points.alias("p")).select("id", F.concat(F.lit("Каталог координат поворотных точек\n"), lines(odd), F.lit("\nСведения о шурфах\n"), lines(lambda p: ~odd(p))).alias("text"))
    return grids.text_points(pages, "id").select("id", "grp", "point_no", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(r"SELECT DISTINCT id, regexp_extract(expert, '[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+') || ': ' || coalesce(trim(executioner), '') AS executors FROM acts WHERE regexp_matches(expert, '[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+')")
def executor_tables(spark: SparkSession, d: str) -> DataFrame:
    """STR-19: experts as tables of executors."""
    acts = table(spark, d, "acts").select("id", "expert", "executioner").distinct()
    cells = F.array(F.array(F.lit("ФИО"), F.lit("Степень участия")), F.array(F.coalesce("expert", F.lit("")), F.coalesce("executioner", F.lit(""))))
    return grids.executor_names(acts.select("id", cells.alias("cells")), "id")


@query(f"SELECT a.id || '-' || a.point_name AS a_id, b.id || '-' || b.point_name AS b_id FROM {POINTS} a JOIN {POINTS} b ON abs(a.lat - (b.lat + 4e-7)) < 1e-6 AND abs(a.lon - b.lon) < 1e-6")
def nearby_points(spark: SparkSession, d: str) -> DataFrame:
    """MAT-22: points against the same points moved by less than the tolerance."""
    key = F.concat_ws("-", F.col("id").cast("string"), "point_name")
    points = _points(spark, d)
    return matching.nearby(points.select(key.alias("a_id"), "lat", "lon"), points.select(key.alias("b_id"), (F.col("lat") + 4e-7).alias("lat"), "lon"))


@query("SELECT DISTINCT id, CASE WHEN b IS NOT NULL AND trim(b) <> coalesce(name, '') THEN trim(b) WHEN address IS NOT NULL AND trim(address) <> coalesce(name, '') THEN trim(address) ELSE '' END AS picked FROM (SELECT *, CASE WHEN id % 3 = 0 THEN obj_info WHEN id % 3 = 1 THEN name END AS b FROM identified_archaeological_heritage_sites)")
def picked_addresses(spark: SparkSession, d: str) -> DataFrame:
    """STR-29."""
    rows = table(spark, d, "identified_archaeological_heritage_sites")
    second = F.when(F.col("id") % 3 == 0, F.col("obj_info")).when(F.col("id") % 3 == 1, F.col("name"))
    return rows.select("id", catalog.picked_address(F.col("address"), second, F.col("name")).alias("picked")).distinct()


@query("SELECT page, total, page < total AS has_next, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, cast((row_number() OVER (ORDER BY doc_id) - 1) // 100 + 1 AS int) AS page, cast(ceil(count(*) OVER () / 100.0) AS int) AS total FROM documents) GROUP BY page, total")
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    """LIM-04: all documents in pages of a hundred."""
    told = register.numbered_pages(table(spark, d, "documents").select("doc_id"), "doc_id")
    return told.groupBy("page", F.col("total_pages").alias("total"), "has_next").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, ends_with(lower(n), '.pdf') AND NOT regexp_matches(lower(n), 'проверк.+подпис.+') AS good FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Проверка подписи.pdf' WHEN doc_id % 3 = 1 THEN 'Акт.PDF' ELSE 'акт.docx' END AS n FROM documents)")
def document_names(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17."""
    name = F.when(F.col("doc_id") % 3 == 0, "Проверка подписи.pdf").when(F.col("doc_id") % 3 == 1, "Акт.PDF").otherwise("акт.docx")
    return table(spark, d, "documents").select("doc_id", sources.is_document(name).alias("good"))


@query("SELECT l_orderkey AS page, l_linenumber AS image_id, arg_min(s, (gap, s)) AS caption_id FROM (SELECT l_orderkey, l_linenumber, s, (o_custkey * s) % 300 + 200 - (l_partkey % 100 + 50) AS gap, least(l_suppkey % 50 + 60, 20 * s + 60) - greatest(l_suppkey % 50, 20 * s) AS across FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES (1), (2)) v(s)) WHERE gap >= 0 AND gap < 400 AND across >= 0.3 * 60 GROUP BY ALL")
def image_captions(spark: SparkSession, d: str) -> DataFrame:
    """JOI-10 on boxes made of orders and their lines."""
    y, x = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    images = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("image_id"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 50).alias("y2"))
    heads = table(spark, d, "orders").withColumn("s", F.explode(F.array(F.lit(1), F.lit(2))))
    captions = heads.select(F.col("o_orderkey").alias("page"), F.col("s").alias("caption_id"), (20 * F.col("s")).alias("x1"), ((F.col("o_custkey") * F.col("s")) % 300 + 200).alias("y1"), (20 * F.col("s") + 60).alias("x2"), ((F.col("o_custkey") * F.col("s")) % 300 + 210).alias("y2"))
    return layout.captions_of_images(images, captions)


@query("SELECT id, work FROM (SELECT DISTINCT id, CASE WHEN contains(n, 'раскопки') THEN 'раскопки' WHEN contains(n, 'разведки') THEN 'разведки' ELSE 'наблюдения' END AS work FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'археологические раскопки на объекте' WHEN id % 3 = 1 THEN 'разведки и обследование' ELSE 'только наблюдения' END AS n FROM acts))")
def work_kinds(spark: SparkSession, d: str) -> DataFrame:
    """MAT-18."""
    name = F.when(F.col("id") % 3 == 0, "археологические раскопки на объекте").when(F.col("id") % 3 == 1, "разведки и обследование").otherwise("только наблюдения")
    return table(spark, d, "acts").select("id").distinct().select("id", similarity.work_kind(name).alias("work"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def chat_numbered_messages(spark: SparkSession, d: str) -> DataFrame:
    """JOI-05: messages by their place in their history, none of which is held in one row."""
    return retrieval.numbered(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT json_extract_string(e.value, '$.origin_filename') AS origin_filename FROM acts a, json_each(a.source) e WHERE json_extract_string(a.upload_source, '$.source') <> 'Пользовательский файл' AND json_extract_string(e.value, '$.origin_filename') IS NOT NULL")
def downloaded_files(spark: SparkSession, d: str) -> DataFrame:
    """MAT-07."""
    return matching.downloaded(table(spark, d, "acts"))


@query(f"""WITH p AS (SELECT DISTINCT path FROM {FILES} WHERE id % 2 = 0 AND path IS NOT NULL), n AS (SELECT DISTINCT path FROM {FILES} WHERE id % 2 = 0 AND path IS NOT NULL AND file_hash IS NOT NULL
AND path NOT IN (SELECT path FROM {FILES} WHERE id % 2 = 1 AND path IS NOT NULL) AND file_hash NOT IN (SELECT file_hash FROM {FILES} WHERE id % 2 = 1 AND file_hash IS NOT NULL))
SELECT (SELECT count(*) FROM n) AS new_files, (SELECT count(*) FROM p) - (SELECT count(*) FROM n) AS existing_files""")
def file_news(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04."""
    files = matching.files_of(table(spark, d, "acts"), "id")
    return matching.file_news(files.where("id % 2 = 0"), files.where("id % 2 = 1"))


@query("SELECT DISTINCT id, CASE WHEN id % 4 = 0 THEN 'новое' ELSE username END AS username FROM users UNION ALL SELECT 1000000, 'новый'")
def upserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01: every fourth user again under another name, and a new one."""
    users = table(spark, d, "users").select("id", "username").distinct()
    rows = users.where("id % 4 = 0").select("id", F.lit("новое").alias("username")).unionByName(spark.range(1).select(F.lit(1000000).cast("long").alias("id"), F.lit("новый").alias("username")))
    return changes.upserted(users, rows, "id")
