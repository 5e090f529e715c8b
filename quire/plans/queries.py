"""Registered queries: each is one operator on the driver's tables, beside its SQL oracle.

The tables hold no file names, archives or catalogues, so inputs for those operators are derived
from keys and names by the same expressions on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions import content as B
from quire.functions import genre as G
from quire.functions import isbn as I
from quire.functions import payload as P
from quire.functions import text as T
from quire.operators import classify, dedupe, enrich, index_sync, metrics, model
from quire.operators import metadata as M
from quire.operators.enrich import route
from quire.sources import buckets, state
from quire.streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return ", ".join(map(quoted, xs))


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def by_turn(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def by_turn_sql(key: str, values: list[str]) -> str:
    return f"list_extract([{listed(values)}], cast({key} % {len(values)} + 1 as int))"


# --- texts --------------------------------------------------------------------------------------
_HASHED = f"with c as (select doc_id, md5({clean_sql('text')}) as h from documents)"


def _hashed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("h"))


@query(_HASHED + """
select status, count(*) as n from (
    select case when doc_id = min(doc_id) over (partition by h) then 'unique' else 'duplicate' end as status from c
) group by status""")
def dedupe_status_counts(spark, sf_dir):
    return dedupe.claim(_hashed(spark, sf_dir), "h", ["doc_id"]).groupBy("status").agg(F.count("*").alias("n"))


@query(_HASHED + " select doc_id, h, min(doc_id) over (partition by h) as canonical from c")
def dedupe_canonical(spark, sf_dir):
    return dedupe.claim(_hashed(spark, sf_dir), "h", ["doc_id"]).select("doc_id", "h", "canonical")


@query(_HASHED + " select h, min(doc_id) as first_id, count(*) as n_docs from c group by h having count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return dedupe.duplicate_groups(_hashed(spark, sf_dir), "h", "doc_id")


@query(f"select doc_id, length({clean_sql('text')}) as n_clean from documents")
def clean_text_lengths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.length(T.clean(F.col("text"))).cast("long").alias("n_clean"))


@query(f"select page_id, {clean_sql('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')} as title from pages")
def html_title_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.first_group(F.col("html"), "<title>(.*?)</title>").alias("title"))


@query(f"select page_id, length({clean_sql('html')}) as n_text from pages")
def strip_tags_lengths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.length(T.clean(F.col("html"))).cast("long").alias("n_text"))


@query(f"""select doc_id, {' or '.join(f"contains(lower(left({clean_sql('text')}, 1200)), {quoted(t)})" for t in C.BOOK_CONTENT_TOKENS)} as signals from documents""")
def book_signal_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", classify.book_signals(F.col("text")).alias("signals"))


@query(r"""select doc_id, n < 3 or c >= 0.6 * n as ru, n < 3 or l >= 0.6 * n as en from (
    select doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n,
        length(regexp_replace(text, '[^\x{0400}-\x{04FF}]', '', 'g')) as c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as l
    from documents)""")
def language_script_ratio(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.in_script(text, "ru").alias("ru"), T.in_script(text, "en").alias("en"))


@query("""select doc_id, cast(k as int) as k, substring(text, cast(k as int) * 4000 + 1, 4000) as chunk
from documents, unnest(range(0, least(8, cast(ceil(length(text) / 4000.0) as int)))) as u(k)""")
def text_chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.text_chunks(F.col("text"), 4000, 8)).alias("k", "chunk"))


@query(rf"select doc_id, length(regexp_replace({clean_sql('text')}, '[^\p{{L}}]', '', 'g')) >= 24 as meaningful from documents")
def meaningful_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.has_letters(F.col("text")).alias("meaningful"))


# --- names --------------------------------------------------------------------------------------
_STEMS = """case p_partkey % 6
    when 0 then p_type || ' - ' || p_name when 1 then p_name || ' (' || p_type || ')' when 2 then p_type || '. ' || p_name
    when 3 then 'Alpha_Beta_' || replace(p_name, ' ', '_') when 4 then p_name || '.' || (100000 + p_partkey)
    else cast(p_partkey as varchar) end"""
_STEMS_T = f"with f as (select p_partkey, {_STEMS} as stem from part)"


def _stems(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(_STEMS.replace("varchar", "string")).alias("stem"))


_P = [r"^\s*(.+?)\s*[-–—]\s*(.+?)\s*$", r"^\s*(.+?)\s*\((.+?)\)\s*$", C.FILENAME_PATTERNS[2][1], C.FILENAME_PATTERNS[3][1]]


def _parsed_sql(v: str, field: str) -> str:
    group = lambda first: 1 if first == field else 2
    rest = v if field == "title" else "''"
    return "case " + " ".join(f"when regexp_matches({v}, {quoted(p)}) then trim(regexp_extract({v}, {quoted(p)}, {group(first)}))" for first, p in C.FILENAME_PATTERNS) + f" else {rest} end"


_CLEAN_STEM = clean_sql("replace(stem, '_', ' ')")
_PARSED = f"{_STEMS_T}, p as (select p_partkey, stem, {_parsed_sql(_CLEAN_STEM, 'author')} as author, {_parsed_sql(_CLEAN_STEM, 'title')} as title from f)"


@query(f"{_PARSED} select p_partkey, author, title from p")
def filename_parse(spark, sf_dir):
    return _stems(spark, sf_dir).withColumn("p", T.parse_filename(F.col("stem"))).select("p_partkey", "p.author", "p.title")


@query(rf"""{_STEMS_T} select p_partkey, not regexp_matches(stem, '[-–—]') and len(list_filter(string_split(stem, '_'), lambda x: length(x) >= 2)) >= 3
    and len(list_filter(string_split(stem, '_'), lambda x: length(x) >= 2 and regexp_matches(x, '^\p{{Lu}}\p{{L}}*$'))) >= 2 as book_stem,
    regexp_matches(stem, '\.\d{{5,}}$') as portal_id from f""")
def book_stem_shape(spark, sf_dir):
    stem = F.col("stem")
    return _stems(spark, sf_dir).select("p_partkey", T.looks_like_book_stem(stem).alias("book_stem"), stem.rlike(C.PORTAL_ID).alias("portal_id"))


def _garbage_sql(x: str) -> str:
    v = f"lower({clean_sql(x)})"
    return rf"({v} in ({listed(C.SKIP_VALUES)}) or (regexp_matches({v}, '^[\d_.\-\s]+$') and (contains({v}, '_') or length(regexp_replace({v}, '[_.\-\s]', '', 'g')) >= 5)) or length({v}) < 2)"


_VALUES = ["Unknown", "1984", "665224", "2_530", "12-34", "12-345", "It", "A", "неизвестно", "Dune", "", "N/A", "...", "War and Peace"]


@query(f"with v as (select p_partkey, {by_turn_sql('p_partkey', _VALUES)} as v from part) select p_partkey, {_garbage_sql('v')} as garbage from v")
def garbage_values(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.is_garbage(by_turn(F.col("p_partkey"), _VALUES)).alias("garbage"))


_ODD = ["толстой", "_x", "9 lives", "", ' "q', "a/b:c?", "  ..x.. ", "<b>Title</b>", "...", "Name with  spaces", "x" * 120]


def _letter_sql(x: str) -> str:
    return rf"case when regexp_matches({clean_sql(x)}, '^[\p{{L}}\p{{N}}]') then upper(left({clean_sql(x)}, 1)) else '#' end"


def _safe_sql(x: str, most: int) -> str:
    v = rf"trim(regexp_replace(regexp_replace(regexp_replace({clean_sql(x)}, '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), '\s+', ' ', 'g'))"
    v = f"coalesce(nullif({v}, ''), 'Unknown')"
    return f"case when length({v}) > {most} then regexp_replace(left({v}, {most}), '[ .]+$', '') else {v} end"


@query(f"with v as (select p_partkey, {by_turn_sql('p_partkey', _ODD)} as v from part) select p_partkey, {_safe_sql('v', 90)} as safe from v")
def sanitize_component(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.sanitize(by_turn(F.col("p_partkey"), _ODD)).alias("safe"))


@query(f"select {_letter_sql('p_name')} as letter, count(*) as n from part group by 1")
def first_letter_counts(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(T.first_letter(F.col("p_name")).alias("letter")).agg(F.count("*").alias("n"))


@query(rf"""{_STEMS_T} select p_partkey, coalesce(nullif(upper(left(regexp_replace(stem, '[^\p{{L}}\p{{N}}]', '', 'g'), 2)), ''), '__') as bucket from f""")
def error_bucket(spark, sf_dir):
    return _stems(spark, sf_dir).select("p_partkey", T.error_bucket(F.col("stem")).alias("bucket"))


@query(f"select p_partkey, '/library/' || {_safe_sql('p_type', 48)} || '/' || {_letter_sql('p_brand')} || '/' || {_safe_sql('p_brand', 64)} || '/' || {_safe_sql('p_name', 110)} || '.zip' as dest from part")
def destination_path(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.destination_path("/library", F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("dest"))


_DEST = "'/library/' || p_type || '/' || upper(left(p_brand, 1)) || '/' || p_brand || '/' || p_name || '.zip'"


@query(f"""select p_partkey, regexp_replace(regexp_extract(d, '([^/]*)$', 1), '\\.[^.]+$', '') as title, string_split(substring(d, 10), '/')[-2] as author,
    string_split(substring(d, 10), '/')[-4] as genre from (select p_partkey, {_DEST} as d from part)""")
def metadata_from_path(spark, sf_dir):
    m = T.metadata_of_destination(F.expr(_DEST), F.lit("/library"))
    return read(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.*")


_NUMBERED = "'^(.*)_([1-9][0-9]*)$'"
_ASKED = "case when p_partkey % 5 = 0 then p_name || '_1' else p_name end"


@query(f"""with v as (select p_partkey, {_ASKED} as stem from part), n as (select *, row_number() over (partition by stem order by p_partkey) - 1 as r from v),
t as (select regexp_extract(stem, {_NUMBERED}, 1) as base, list(distinct cast(regexp_extract(stem, {_NUMBERED}, 2) as bigint)) as l from v where regexp_matches(stem, {_NUMBERED}) group by 1)
select p_partkey, case when r = 0 then stem else stem || '_' || list_filter(range(1, r + 2 + coalesce(len(l), 0)), lambda i: not list_contains(coalesce(l, []), i))[r] end || '.zip' as unique_dest from n left join t on base = stem""")
def unique_names(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr(_ASKED), F.lit(".zip")).alias("dest"))
    return dedupe.unique_names(rows, "dest", ["p_partkey"], F.regexp_replace("dest", r"\.zip$", ""), F.lit(".zip")).select("p_partkey", "unique_dest")


_TITLES = ["Dune.294160", "Frank Herbert Dune", "Herbert Frank Dune", "Frank Herbert - Dune", "Dune", "Frank Herbert", "War_291543"]


@query(f"""select p_partkey, list_extract(['Dune', 'Dune', 'Dune', 'Dune', 'Dune', 'Frank Herbert', 'War'], cast(p_partkey % {len(_TITLES)} + 1 as int)) as title from part""")
def book_title_clean(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.clean_book_title(by_turn(F.col("p_partkey"), _TITLES), F.lit("Frank Herbert")).alias("title"))


_SOURCES = ["/a;/b", " /a ; /b\n/a", ";;", "/c"]


@query(f"""with v as (select p_partkey, list_filter(list_transform(string_split(replace({by_turn_sql('p_partkey', _SOURCES)}, chr(10), ';'), ';'), lambda x: trim(x)), lambda x: x <> '') as l from part)
select p_partkey, len(list_distinct(l)) as n_sources, coalesce(l[1], '') as first_source from v""")
def source_list_split(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", T.split_sources(by_turn(F.col("p_partkey"), _SOURCES)).alias("l"))
    return rows.select("p_partkey", F.size("l").cast("long").alias("n_sources"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_source"))


# --- genres -------------------------------------------------------------------------------------
_RAW = [
    "sf_action", "Science", "computer science", "Учебная литература", "party games", "Домашняя кухня", "roman history", "war stories", "warm", "ISBN 123",
    "12345", "", "Quantum", "Фантастика", "поэзия", "home_garden", "cook book", "Unknown", "n/a", "love_story", "ECONOMY", "lawrence", "self-help", "Спорт",
    "travel/guide", "novel", "mathematics", "www.x.y", "a" * 70, "non-fiction",
]


def _rules_sql(pairs, default: str, hit) -> str:
    return "case " + " ".join(f"when {' or '.join(hit(k) for k in keys)} then {quoted(out)}" for out, keys in pairs) + f" else {quoted(default)} end"


def _genre_sql(x: str) -> str:
    raw, low = clean_sql(x), f"lower({clean_sql(x)})"
    spaced = rf"trim(regexp_replace(regexp_replace({low}, '[_/\\|;:,\-]+', ' ', 'g'), '\s+', ' ', 'g'))"
    exact = "case " + " ".join(f"when {low} = {quoted(g.lower())} then {quoted(g)}" for g in C.GENRES) + " else '' end"
    bad = rf"{low} in ('', {listed(C.GENRE_PLACEHOLDERS)}) or regexp_matches({raw}, {quoted(C.GENRE_NOISE)}) or regexp_matches({raw}, '^[\d\s._#;,:/\\-]+$') or length({raw}) > 64 or length(regexp_replace({raw}, '[^0-9]', '', 'g')) >= 5"
    rules = _rules_sql(C.GENRE_RULES, "Unknown", lambda k: f"contains({spaced}, {quoted(k)}) or contains({low}, {quoted(k)})")
    return f"case when {bad} then 'Unknown' when {exact} <> '' then {exact} else {rules} end"


_RAW_T = f"with v as (select p_partkey, {by_turn_sql('p_partkey', _RAW)} as v from part)"


def _raw(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", by_turn(F.col("p_partkey"), _RAW).alias("v"))


@query(f"{_RAW_T} select p_partkey, {_genre_sql('v')} as genre from v")
def genre_normalize(spark, sf_dir):
    return _raw(spark, sf_dir).select("p_partkey", G.normalize(F.col("v")).alias("genre"))


@query(f"select p_partkey, {_genre_sql('''p_name || ' ' || p_type''')} as genre from part")
def genre_of_parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", G.normalize(F.concat_ws(" ", "p_name", "p_type")).alias("genre"))


@query(f"select genre, count(*) as n from (select {_genre_sql('''p_name || ' ' || p_type''')} as genre from part) group by genre")
def genre_histogram(spark, sf_dir):
    return metrics.genre_histogram(read(spark, sf_dir, "part").select(G.normalize(F.concat_ws(" ", "p_name", "p_type")).alias("genre")))


@query(f"{_RAW_T}, g as (select p_partkey, {_genre_sql('v')} as g from v) select p_partkey, case g {' '.join(f'when {quoted(a)} then {quoted(b)}' for a, b in C.GENRES.items())} end as genre_en from g")
def genre_translate(spark, sf_dir):
    return _raw(spark, sf_dir).select("p_partkey", G.translated(F.col("v"), "en").alias("genre_en"))


_EXTS = [".epub", ".fb2", ".txt", ".jpg", ".xyz", ".zip", ".pdf", ""]
_PATH = f"'/lib/' || {{raw}} || '/' || p_brand || '/' || p_name || {{ext}}"
_PATHS_T = f"with f as (select p_partkey, {_PATH.format(raw=by_turn_sql('p_partkey', _RAW), ext=by_turn_sql('p_partkey', _EXTS))} as path from part)"


def _paths(spark, sf_dir):
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/lib/"), by_turn(key, _RAW), F.lit("/"), "p_brand", F.lit("/"), "p_name", by_turn(key, _EXTS)).alias("path"))


@query(f"{_PATHS_T} select p_partkey, {_rules_sql(C.PATH_GENRES, '', lambda k: f'contains(lower(path), {quoted(k)})')} as genre from f")
def genre_from_path(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", G.from_path(F.col("path")).alias("genre"))


# --- classification -----------------------------------------------------------------------------
_EXT_SQL = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1))"


@query(f"""{_PATHS_T} select ext, kind, count(*) as n from (select {_EXT_SQL} as ext, case when {_EXT_SQL} in ({listed(C.ARCHIVE_EXTENSIONS)}) then 'archive'
    when {_EXT_SQL} in ({listed(C.TEXT_EXTENSIONS)}) then 'text' when {_EXT_SQL} in ({listed(C.BOOK_EXTENSIONS)}) then 'book'
    when {_EXT_SQL} in ({listed(C.STRONG_NONBOOK_EXTENSIONS)}) then 'nonbook' else 'unknown' end as kind from f) group by ext, kind""")
def classify_extension(spark, sf_dir):
    ext = T.suffix_of(F.col("path"))
    kind = F.when(ext.isin(C.ARCHIVE_EXTENSIONS), "archive").when(ext.isin(C.TEXT_EXTENSIONS), "text").when(ext.isin(C.BOOK_EXTENSIONS), "book").when(ext.isin(C.STRONG_NONBOOK_EXTENSIONS), "nonbook").otherwise("unknown")
    return _paths(spark, sf_dir).groupBy(ext.alias("ext"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""with f as (select p_partkey, '/lib/' || p_name || {by_turn_sql('p_partkey', ['.epub', '.fb2', '.jpg', '.xyz', '.bin', ''])} as path, case when p_partkey % 11 = 0 then 0 else 1000 * p_size * p_size end as size_bytes from part),
e as (select *, {_EXT_SQL} as ext from f)
select p_partkey, case when size_bytes = 0 then 'empty_file' when ext in ('.epub', '.fb2') then 'book_ext:' || ext when ext in ('.jpg', '.bin') then 'nonbook_ext:' || ext
    when size_bytes < 65536 then 'tiny_unknown_binary:' || coalesce(nullif(ext, ''), 'no_ext') else 'unknown_binary_not_book_type:' || coalesce(nullif(ext, ''), 'no_ext') end as reason,
    size_bytes > 0 and ext in ('.epub', '.fb2') as is_book from e""")
def classify_files(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = read(spark, sf_dir, "part").select(key, F.concat(F.lit("/lib/"), "p_name", by_turn(key, [".epub", ".fb2", ".jpg", ".xyz", ".bin", ""])).alias("path"), F.when(key % 11 == 0, 0).otherwise(1000 * size * size).alias("size_bytes"))
    v = classify.verdict(F.col("path"), F.col("size_bytes"), F.lit(""), F.lit(False), F.lit(True), F.lit(""))
    return rows.select("p_partkey", v.alias("v")).select("p_partkey", "v.reason", "v.is_book")


_TEXTS = ["Frank Herbert - Dune.txt", "Alpha_Beta_Gamma.txt", "Gasnikov_Oktyabr.292696.txt", "plain.txt", "notes.md"]


@query(f"""select doc_id, case when {' or '.join(f"contains(lower(left({clean_sql('text')}, 1200)), {quoted(t)})" for t in C.BOOK_CONTENT_TOKENS)} then 'text_book_signals'
    when doc_id % 5 in (0, 1) then 'text_book_filename' when doc_id % 5 = 2 then 'text_library_portal_id' else 'text_no_book_signals' end as reason from documents""")
def classify_texts(spark, sf_dir):
    path = F.concat(F.lit("/t/"), by_turn(F.col("doc_id"), _TEXTS))
    v = classify.verdict(path, F.lit(10), F.col("text"), F.lit(False), F.lit(False), F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", v["reason"].alias("reason"))


@query("select p_partkey, p_partkey % 4 = 0 as has_sidecar from part")
def sidecar_semi_join(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/s/"), F.col("p_partkey").cast("string")).alias("s"))
    files = part.select("p_partkey", F.concat("s", F.lit(".txt")).alias("path")).union(part.where("p_partkey % 4 = 0").select("p_partkey", F.concat("s", F.lit(".fbd")).alias("path")))
    return classify.with_sidecar(files).where(T.suffix_of(F.col("path")) == ".txt").select("p_partkey", "has_sidecar")


# --- ISBN ---------------------------------------------------------------------------------------
_BARE = "'978' || lpad(cast(p_partkey as varchar), 9, '0')"
_SUM = " + ".join(f"{3 if k % 2 else 1} * cast(substring(b, {k + 1}, 1) as int)" for k in range(12))
_ISBN_T = f"with b as (select p_partkey, {_BARE} as b from part), i as (select p_partkey, b || cast(((10 - ({_SUM}) % 10) % 10 + case when p_partkey % 3 = 0 then 1 else 0 end) % 10 as varchar) as isbn, p_partkey % 3 <> 0 as good from b)"


def _isbns(spark, sf_dir):
    string = lambda sql: sql.replace("varchar", "string")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(string(_BARE)).alias("b"))
    return rows.select("p_partkey", F.expr(string(f"b || cast(((10 - ({_SUM}) % 10) % 10 + case when p_partkey % 3 = 0 then 1 else 0 end) % 10 as varchar)")).alias("isbn"))


@query(f"{_ISBN_T} select p_partkey, isbn, good as valid from i")
def isbn_validate(spark, sf_dir):
    return _isbns(spark, sf_dir).select("p_partkey", "isbn", I.valid13(F.col("isbn")).alias("valid"))


@query(f"{_ISBN_T} select p_partkey, case when good then isbn || ',' else '' end || '080442957X' as isbns from i")
def isbn_extract(spark, sf_dir):
    text = F.concat(F.lit("ISBN: "), F.substring("isbn", 1, 3), F.lit("-"), F.substring("isbn", 4, 10), F.lit(" and ISBN 0-8044-2957-X end"))
    return _isbns(spark, sf_dir).select("p_partkey", F.array_join(I.extract(text), ",").alias("isbns"))


# --- joins and windows --------------------------------------------------------------------------
_LISTING = "select o_orderkey as path_key, cast(o_totalprice * 100 as bigint) as size_bytes, o_orderkey * 1000 as mtime_ns from orders where o_orderkey % 2 = 0"
_INDEX = "select o_orderkey as path_key, cast(o_totalprice * 100 as bigint) + case when o_orderkey % 7 = 0 then 1 else 0 end as size_bytes, o_orderkey * 1000 as mtime_ns, case when o_orderkey % 5 = 0 then null else 'h' || o_orderkey end as xxh64, case when o_orderkey % 13 = 0 then 'failed' else 'ok' end as status from orders where o_orderkey % 3 = 0"
_BOTH = f"with listing as ({_LISTING}), idx as ({_INDEX})"


def _sql(spark, sf_dir, text, *tables):
    """Evaluate a SELECT of both dialects over named tables."""
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text.replace("varchar", "string"))


@query(f"""{_BOTH} select l.path_key, case when l.size_bytes = i.size_bytes and l.mtime_ns = i.mtime_ns and i.xxh64 is not null and i.status = 'ok' then 'cached' else 'pending' end as change
from listing l left join idx i using (path_key)""")
def index_changes(spark, sf_dir):
    return index_sync.changes(_sql(spark, sf_dir, _LISTING, "orders"), _sql(spark, sf_dir, _INDEX, "orders")).select("path_key", "change")


@query(f"{_BOTH} select path_key, xxh64 from idx where path_key not in (select path_key from listing)")
def stale_index(spark, sf_dir):
    return index_sync.stale(_sql(spark, sf_dir, _INDEX, "orders"), _sql(spark, sf_dir, _LISTING, "orders")).select("path_key", "xxh64")


@query(f"""{_BOTH}, j as (select l.path_key, l.size_bytes = i.size_bytes and i.xxh64 is not null and i.status = 'ok' as same from listing l left join idx i using (path_key))
select count(*) as found, count(*) filter (where same) as cached, count(*) filter (where same is not true) as queued,
    (select count(*) from idx where path_key not in (select path_key from listing)) as removed_index,
    (select count(*) from idx where xxh64 is not null and path_key not in (select path_key from listing)) as removed_hashes from j""")
def index_counters(spark, sf_dir):
    listing, index = _sql(spark, sf_dir, _LISTING, "orders"), _sql(spark, sf_dir, _INDEX, "orders")
    return index_sync.counters(listing, index, index.where("xxh64 is not null").select("xxh64", F.col("path_key").alias("canonical_zip")))


@query("select user_id, arg_max(event_type, (ts, event_id)) as status from events group by user_id")
def latest_status(spark, sf_dir):
    return dedupe.latest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "status")


@query("select event_id, event_type from events order by ts desc, event_id desc limit 10")
def last_events(spark, sf_dir):
    return dedupe.last_events(read(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "event_type")


# --- aggregates ---------------------------------------------------------------------------------
@query("select event_type, count(*) as processed, count(*) filter (where value < 5) as errors from events group by event_type")
def stage_counters(spark, sf_dir):
    return metrics.stage_counters(read(spark, sf_dir, "events"), "event_type", F.col("value") < 5)


@query("select o_orderstatus as result, count(*) as n from orders group by 1")
def result_counters(spark, sf_dir):
    return metrics.result_counters(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "result"))


_CHILDREN = "select l_orderkey as archive_source, l_linenumber % 2 = 0 as is_book, case when l_linestatus = 'F' and l_linenumber = 1 then null else case l_returnflag when 'A' then 'packed' when 'N' then 'nobook' else 'failed' end end as result, cast(l_quantity as bigint) as size_bytes from lineitem"


@query(f"""select archive_source, count(*) as n_seen, count(*) filter (where result is null) as pending, count(*) filter (where is_book) as book_total,
    count(*) filter (where is_book and result = 'packed') as book_packed, count(*) filter (where result = 'failed' or (is_book and result <> 'packed')) as failed, cast(sum(size_bytes) as bigint) as bytes,
    case when count(*) filter (where result is null) > 0 then 'wait' when count(*) filter (where is_book) > 0 then 'delete_eligible' else 'move_nobook' end as action
from ({_CHILDREN}) group by archive_source""")
def archive_rollup(spark, sf_dir):
    return metrics.archive_rollup(_sql(spark, sf_dir, _CHILDREN, "lineitem"))


_TOTALS = "select cast(sum(l_quantity) as bigint) * 100000 as bytes_seen, cast(sum(case when l_linestatus = 'F' then l_quantity else 0 end) as bigint) * 100000 as bytes_done, count(*) as seen, sum(case when l_linestatus = 'F' then 1 else 0 end) as done, 7 as queued_a2, 100 as a2, 5000 as a3, 11 as queued from lineitem"


@query(f"""with t as ({_TOTALS}), r as (select *, bytes_seen / 1073741824.0 as s, bytes_done / 1073741824.0 as d from t), q as (select *, d / 600 * 60 as rate from r)
select seen, cast(done as bigint) as done, d / s * 100 as pct, round_even(s, 2) as gb_seen, round_even(d, 2) as gb_done, round_even(rate, 2) as gb_per_min,
    printf('%02d:%02d:%02d', cast(floor((s - d) / rate * 60) as bigint) // 3600, cast(floor((s - d) / rate * 60) as bigint) % 3600 // 60, cast(floor((s - d) / rate * 60) as bigint) % 60) as eta,
    cast(seen - done + 11 + floor(7 * least(64.0, a3 / 100.0) * least(1.0, seen / a3)) as bigint) as backlog,
    cast(seen + 11 + floor(7 * least(64.0, a3 / 100.0) * least(1.0, seen / a3)) as bigint) as estimated_total from q""")
def metrics_snapshot(spark, sf_dir):
    return metrics.snapshot(_sql(spark, sf_dir, _TOTALS, "lineitem"), F.lit(600))


@query("""select count(*) as n, count(*) filter (where starts_with(p_name, string_split(p_name, ' ')[1]) and p_partkey % 4 <> 0) as author_in_title,
    count(*) filter (where p_partkey % 4 = 0) as unknown_author, count(*) filter (where p_partkey % 10 = 3) as numeric_suffix from part""")
def title_qa(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.concat("p_name", F.when(key % 10 == 3, ".2024").otherwise("")).alias("title"), F.when(key % 4 == 0, "Неизвестный автор").otherwise(F.get(F.split("p_name", " "), F.lit(0))).alias("author"))
    return metrics.title_quality(rows)


@query("""select l_orderkey, member, size from (select l_orderkey, 'm' || l_linenumber || case when l_linenumber % 2 = 0 then '.epub' else '.jpg' end as member, cast(l_quantity as bigint) as size,
    row_number() over (partition by l_orderkey order by l_linenumber % 2 = 0 desc, cast(l_quantity as bigint) desc, l_linenumber, l_partkey) as k from lineitem) where k = 1""")
def payload_argmax(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("m"), line.cast("string"), F.when(line % 2 == 0, ".epub").otherwise(".jpg")).alias("member"), F.col("l_quantity").cast("long").alias("size"), line.alias("pos"))
    return metrics.largest_member(rows, "l_orderkey")


# --- metadata -----------------------------------------------------------------------------------
_META = "select d.doc_id, text as title, case doc_id % 3 when 0 then 'Unknown' when 1 then '' else 'A. Writer' end as author, case doc_id % 2 when 0 then 'Unknown' else 'История' end as genre, case doc_id % 5 when 0 then 'tags' else 'filename' end as source, case doc_id % 7 when 0 then 0.8 else 0.35 end as confidence from documents d"


@query(f"""with m as ({_META}), n as (select *, {_garbage_sql('title')} as bad from m)
select doc_id, case when not (source = 'tags' and confidence >= 0.75 and not bad) and (bad or author in ('', 'Unknown')) then 'full'
    when not bad and author not in ('', 'Unknown') and genre = 'Unknown' then 'genre_only' when source = 'tags' and confidence >= 0.75 then 'skip:tags_confident' else 'skip:metadata_sufficient' end as decision from n""")
def lm_decision(spark, sf_dir):
    rows = _sql(spark, sf_dir, _META, "documents")
    return rows.select("doc_id", M.decision(*(F.col(c) for c in ("title", "author", "genre", "source", "confidence"))).alias("decision"))


@query(rf"""select doc_id, case when doc_id % 3 = 0 then 'skip' when length(regexp_replace({clean_sql('text')}, '[^\p{{L}}]', '', 'g')) >= 24 then 'snippet' else 'fallback_context' end as lm_route from documents""")
def enrichment_route(spark, sf_dir):
    wanted = F.when(F.col("doc_id") % 3 == 0, "skip:metadata_sufficient").otherwise("full")
    return read(spark, sf_dir, "documents").select("doc_id", route(wanted, F.col("text")).alias("lm_route"))


_ANSWER = "select doc_id, 'Old title' as title, 'Old author' as author, case doc_id % 2 when 0 then 'Unknown' else 'История' end as genre, 0.35D as confidence, 'filename' as source"


@query("""select doc_id, case when doc_id % 3 = 0 then 'Old title' else 'New title' end as title, 'New author' as author,
    case when doc_id % 2 = 0 or doc_id % 5 = 0 then 'Поэзия' else 'История' end as genre, case when doc_id % 5 = 0 then 4.6 else 3.0 end as confidence, 'model' as source from documents""")
def model_merge(spark, sf_dir):
    key = F.col("doc_id")
    answer = F.struct(F.when(key % 3 == 0, "Unknown").otherwise("New title").alias("title"), F.lit("New author").alias("author"), F.lit("poetry").alias("genre"), F.when(key % 5 == 0, "4.6").otherwise("3").alias("confidence"))
    rows = _sql(spark, sf_dir, f"{_ANSWER} from documents", "documents").withColumn("answer", answer)
    return M.merge_answer(rows).drop("answer")


@query("select p_partkey, p_name as title, p_type as author, case when p_partkey % 2 = 0 then 'poetry' else 'history' end as genre, 3.5 as confidence from part")
def payload_shape(spark, sf_dir):
    key = F.col("p_partkey")
    fields = F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.when(key % 2 == 0, "poetry").otherwise("history").alias("genre"), F.lit("3.5").alias("confidence"))
    text = F.when(key % 3 == 0, F.to_json(F.struct(F.array(fields).alias("results")))).otherwise(F.to_json(fields))
    s = P.shape_native(text)
    return read(spark, sf_dir, "part").select("p_partkey", *(s[c].alias(c) for c in ("title", "author", "genre", "confidence")))


@query("""select p_partkey, p_name as title, case when p_partkey % 3 = 2 then 'sf' else 'poetry' end as genre from part""")
def payload_parse(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n{'title': '"), "p_name", F.lit("', 'genre': 'poetry',}\n```"))
    lines = F.concat(F.lit("Название: "), "p_name", F.lit("\nжанр - poetry\n"))
    nested = F.concat(F.lit('Sure: {"results": [{"title": "'), "p_name", F.lit('", "genre": "x", "genre_analysis": {"primary_genre": "sf"}}]} done'))
    text = F.element_at(F.array(fenced, lines, nested), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", P.parse_payload(text).alias("p")).select("p_partkey", "p.title", "p.genre")


@query()
def xxh64_content(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", B.xxh64(F.col("text").cast("binary")).alias("xxh64"))


@query("select doc_id, text as decoded from documents")
def smart_decode(spark, sf_dir):
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))
    raw = F.element_at(F.array(F.col("text").cast("binary"), F.encode("text", "UTF-16"), marked), (F.col("doc_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", B.smart_decode(raw).alias("decoded"))


# --- names, paths and metadata of derived files ---------------------------------------------------
_FILE = "select p_partkey, '/lib/' || p_type || '/' || p_brand || ' - ' || p_name || case p_partkey % 4 when 0 then '.txt' when 1 then '.epub' when 2 then '.jpg' else '.pdf' end as path, case when p_partkey % 3 = 0 then '/in/box.zip' end as archive, p_brand, p_name, p_type from part"


@query("select p_partkey, case when length(p_name) > 12 then left(p_name, 9) || '...' else p_name end as short from part")
def truncate_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.truncate(F.col("p_name"), 12).alias("short"))


@query(f"select p_partkey, case when p_partkey % 2 = 0 then substring(path, 6) else regexp_extract(path, '[^/]*$') end as rel from ({_FILE})")
def relative_path(spark, sf_dir):
    base = F.when(F.col("p_partkey") % 2 == 0, "/lib").otherwise("/elsewhere")
    return _sql(spark, sf_dir, _FILE, "part").select("p_partkey", T.relative(F.col("path"), base).alias("rel"))


@query(f"select p_partkey, '/dupes/' || left(md5(p_name), 12) || '/' || case when archive is not null then 'box__' else '' end || regexp_extract(path, '[^/]*$') as dest from ({_FILE})")
def duplicate_path(spark, sf_dir):
    return _sql(spark, sf_dir, _FILE, "part").select("p_partkey", T.duplicate_path("/dupes", F.md5("p_name"), F.col("path"), F.col("archive")).alias("dest"))


@query(f"""select p_partkey, case when archive is not null then '/no/FromArchives/b.zip__c.zip__d.zip/' || regexp_extract(path, '[^/]*$') else '/no/' || substring(path, 6) end as dest from ({_FILE})""")
def nobook_path(spark, sf_dir):
    chain = F.when(F.col("archive").isNotNull(), F.array(*map(F.lit, ("a.zip", "b.zip", "c.zip", "d.zip")))).otherwise(F.array().cast("array<string>"))
    return _sql(spark, sf_dir, _FILE, "part").select("p_partkey", T.nobook_path("/no", F.col("path"), F.lit("/lib"), chain, True).alias("dest"))


@query(f"""select p_partkey, left({clean_sql("'Filename: ' || regexp_extract(path, '[^/]*$') || ' Stem: ' || p_brand || ' - ' || p_name || ' Suffix: ' || regexp_extract(path, '[.][^.]*$') || ' Parent: ' || p_type || case when archive is not null then ' Archive chain: box.zip -> in.zip' else '' end || ' Possible author from filename: ' || p_brand || ' Possible title from filename: ' || p_name")}, 90) as context from ({_FILE})""")
def fallback_context(spark, sf_dir):
    chain = F.when(F.col("archive").isNotNull(), F.array(F.lit("box.zip"), F.lit("in.zip"))).otherwise(F.array().cast("array<string>"))
    return _sql(spark, sf_dir, _FILE, "part").select("p_partkey", T.fallback_context(F.col("path"), chain, 90).alias("context"))


@query(f"""select p_partkey, case when p_partkey % 2 = 0 then 'Known title' else p_name end as title, case when p_partkey % 3 = 1 then 'Known author' else p_brand end as author from ({_FILE})""")
def best_names(spark, sf_dir):
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    title, author = F.when(key % 2 == 0, "Known title").otherwise("665224"), F.when(key % 3 == 1, "Known author").otherwise("Unknown")
    return _sql(spark, sf_dir, _FILE, "part").select("p_partkey", M.best_title(title, F.col("path"), none).alias("title"), M.best_author(author, F.col("path"), none).alias("author"))


_CODE = "case when p_partkey % 4 = 0 then '978-0-306-40615-7' when p_partkey % 4 = 1 then '0306406152' else '' end"


@query(f"""select p_partkey, case when p_partkey % 4 = 0 then '9780306406157' when p_partkey % 4 = 1 then '0306406152' when p_partkey % 4 = 2 then '080442957X' else '' end as isbn,
    p_partkey % 4 <> 3 and (p_partkey % 5 = 0 or p_partkey % 7 = 0) as lookup from part""")
def isbn_lookup(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.when(key % 4 == 2, "see ISBN 0-8044-2957-X there").otherwise("no number")
    found = M.isbn_candidates(F.lit("/a/book.txt"), [F.concat(F.lit("ISBN "), F.expr(_CODE))], text)
    title, author = F.when(key % 5 == 0, "").otherwise("A title"), F.when(key % 7 == 0, "Unknown").otherwise("An author")
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("isbn"), M.isbn_lookup_needed(found, title, author).alias("lookup"))


@query("select p_partkey, p_partkey % 2 = 0 and p_partkey % 3 <> 0 and p_partkey % 5 >= 3 as strong from part")
def strong_answers(spark, sf_dir):
    key = F.col("p_partkey")
    title, genre = F.when(key % 2 == 0, F.col("p_name")).otherwise("Unknown"), F.when(key % 3 == 0, "Unknown").otherwise("poetry")
    confidence = by_turn(key, ["", "x", "3.9", "4.0", "5"])
    return read(spark, sf_dir, "part").select("p_partkey", M.strong_answer(title, genre, confidence).alias("strong"))


@query(f"""select count(*) filter (where p_partkey % 4 <> 2) as provisional, count(*) filter (where p_partkey % 4 < 2) as seen, count(*) filter (where p_partkey % 4 < 2 and p_partkey % 3 = 0) as done,
    cast(sum(p_size) as bigint) as bytes_seen, cast(sum(case when p_partkey % 3 = 0 then p_size end) as bigint) as bytes_done from part""")
def book_counters(spark, sf_dir):
    key = F.col("p_partkey")
    rows = _sql(spark, sf_dir, _FILE, "part").join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size_bytes")), "p_partkey")
    return metrics.book_counters(rows.withColumn("is_book", key % 4 < 2).withColumn("result", F.when(key % 3 == 0, "packed")))


_HEADS = [("25504446", "pdf"), ("504B0304", "zip"), ("89504E470D0A1A0A", "png"), ("1F8B08", "gz"), ("FFD8FF", "jpg"), ("00", "")]


@query(f"""select p_partkey, {by_turn_sql('p_partkey', [k for _, k in _HEADS])} as kind, p_partkey % {len(_HEADS)} in (0, 2, 4) as settled,
    p_partkey % {len(_HEADS)} in (1, 3) as archive, case p_partkey % {len(_HEADS)} when 0 then 'pdf' else '' end as magic from part""")
def file_kinds(spark, sf_dir):
    content = F.unhex(F.concat(by_turn(F.col("p_partkey"), [h for h, _ in _HEADS]), F.hex("p_name")))
    kind = B.kind_of(content)
    is_book, is_nonbook = classify.kind_is_book(kind["ext"], kind["mime"], F.lit("")), classify.kind_is_nonbook(kind["ext"], kind["mime"], F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", kind["ext"].alias("kind"), (is_book | is_nonbook).alias("settled"), classify.kind_is_archive(kind["ext"], kind["mime"]).alias("archive"), B.magic(content).alias("magic"))


@query("""select p_partkey, p_partkey % 3 = 1 as is_binary, p_partkey % 2 = 1 as is_archive from part""")
def byte_checks(spark, sf_dir):
    key = F.col("p_partkey")
    head = F.when(key % 3 == 1, F.concat(F.unhex(F.lit("00")), F.col("p_name").cast("binary"))).otherwise(F.col("p_name").cast("binary"))
    path = F.concat(F.lit("/a/x"), F.when(key % 2 == 1, ".zip").otherwise(".epub"))
    return read(spark, sf_dir, "part").select("p_partkey", B.looks_binary(head).alias("is_binary"), B.is_archive(path, head, F.lit(None).cast("string")).alias("is_archive"))


@query("select o_orderpriority as genre, count(*) as n from orders group by 1 order by n desc, genre limit 3")
def top_genres(spark, sf_dir):
    return metrics.genre_histogram(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "genre")).limit(3)


# --- model requests ------------------------------------------------------------------------------
def _fake_model(requests: list[str]) -> list[str | None]:
    """Answers by the length of the request: none, a weak or a strong answer."""
    strong, weak = '{"title": "New title", "genre": "poetry", "confidence": 4.5}', '{"title": "Weak title", "genre": "", "confidence": 1}'
    return [(None, weak, strong)[len(r) % 3] for r in requests]


@query("""with r as (select p_partkey % 4 as d, length(p_name) % 3 as f, case when length(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) >= 20 then length(p_type) else length(p_name) end % 3 as s from part),
o as (select case when d < 2 then list_concat(['processed', 'fast_request', case f when 0 then 'fast_no_result' when 1 then 'fast_fallback' else 'fast_ok' end],
        case when f = 2 then [] else ['full_request', case s when 0 then 'full_no_result' else 'full_ok' end] end)
    when d = 2 then ['processed', 'genre_only_request', case f when 0 then 'genre_only_no_result' else 'genre_only_ok' end] else ['processed', 'skipped'] end as l from r)
select lm_outcome, count(*) as n from (select unnest(l) as lm_outcome from o) group by 1""")
def model_outcomes(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("context"), F.col("p_type").alias("snippet"), F.when(key % 4 < 2, "full").when(key % 4 == 2, "genre_only").otherwise("skip:metadata_sufficient").alias("lm_decision"), F.lit("Old title").alias("title"), F.lit("Old author").alias("author"), F.lit("Unknown").alias("genre"), F.lit(0.35).alias("confidence"), F.lit("filename").alias("source"))
    asking = model.Asking(fast=_fake_model, full=_fake_model, genre=_fake_model, least_letters=20)
    asked, _ = model.ask(rows, asking, spark.createDataFrame([], "cache_key string, payload_json string"))
    return model.stats_counters(asked)


_LOG = ["A6 full_ok path=/a data={}", "x A6 fast_ok path=/a data={\"t\": 1}", "A6 iter_ok path=/a", "A6 fast_fallback path=/b conf=1 data={}", "other {}"]


@query(f"""select regexp_extract(l, 'A6 (full_ok|iter_ok|fast_ok|fast_fallback) .*?[{{].*[}}]', 1) as kind, count(*) as n from (select {by_turn_sql('p_partkey', _LOG)} as l from part) where regexp_extract(l, 'A6 (full_ok|iter_ok|fast_ok|fast_fallback) .*?[{{].*[}}]', 1) <> '' group by 1""")
def model_result_kinds(spark, sf_dir):
    return metrics.model_result_kinds(read(spark, sf_dir, "part").select(by_turn(F.col("p_partkey"), _LOG).alias("value")))


_NO_ANSWERS = "cache_key string, payload_json string"


def _reader(requests: list[str]) -> list[str | None]:
    """Wants more text until a piece holds a multiple of five times the letter e."""
    sure = [json.loads(r)[-1].count("e") % 5 == 0 for r in requests]
    return [json.dumps({"title": "T", "confidence": 5 if yes else 1, "need_more_text": True}) for yes in sure]


@query("""with c as (select doc_id, text, least(cast(ceil(length(text) / 400.0) as int), 4) as n from documents),
p as (select doc_id, n, k, substring(text, cast(k as int) * 400 - 399, 400) as piece from c, range(1, 5) as r(k) where k <= n)
select doc_id, cast(coalesce(min(case when (length(piece) - length(replace(piece, 'e', ''))) % 5 = 0 then k end), max(n)) as int) as rounds from p group by doc_id""")
def model_rounds(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.text_chunks(F.col("text"), 400, 4).alias("pieces"))
    answers, _ = model.ask_rounds(rows, "doc_id", "pieces", _reader, spark.createDataFrame([], _NO_ANSWERS), most=4)
    return answers.select("doc_id", "rounds")


@query("""select p_partkey, case when p_partkey % 2 = 1 then p_name when p_partkey % 7 = 0 then 'One' when p_partkey % 5 = 1 then 'Two' else '' end as title,
    case when p_partkey % 2 = 0 and (p_partkey % 7 = 0 or p_partkey % 5 = 1) then 'isbn' else 'filename' end as source from part""")
def isbn_rounds(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(key % 2 == 1, F.col("p_name")).otherwise("").alias("title"), F.lit("An author").alias("author"), F.lit("Unknown").alias("genre"), F.lit(0.35).alias("confidence"), F.lit("filename").alias("source"), F.array(F.concat(F.lit("a"), (key % 7).cast("string")), F.concat(F.lit("b"), (key % 5).cast("string"))).alias("found"))
    one = lambda requests: ['{"title": "One"}' if r == "a0" else None for r in requests]
    two = lambda requests: ['{"items": [{"volumeInfo": {"title": "Two"}}]}' if r == "b1" else None for r in requests]
    providers = [("openlibrary", one, enrich.open_library), ("googlebooks", two, enrich.google_books)]
    out, _ = enrich.ask_isbn(rows, ["p_partkey"], "found", providers, spark.createDataFrame([], _NO_ANSWERS))
    return out.select("p_partkey", "title", "source")


@query("""select p_partkey, case when p_partkey % 6 = 0 then 'Война и мир' else 'Книга ' || case when p_partkey % 2 = 0 then 'Война и мир' else p_name end end as title,
    case when p_partkey % 3 = 0 then 'Лев Толстой' else p_brand end as author from part""")
def translated_names(spark, sf_dir):
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(key % 2 == 0, "Война и мир").otherwise(F.col("p_name")).alias("title"), F.when(key % 3 == 0, "Лев Толстой").otherwise(F.col("p_brand")).alias("author"))
    provider = lambda requests: [json.dumps({"title": f"Книга {json.loads(r)['title']}", "author": ""}) for r in requests]
    return model.translate_names(rows, provider, spark.createDataFrame([], _NO_ANSWERS), "ru")[0]


# --- state across runs ---------------------------------------------------------------------------
@query(f"""with v as (select p_partkey, {_ASKED} as stem from part), e as (select distinct stem from v where p_partkey % 2 = 0),
n as (select v.*, row_number() over (partition by v.stem order by p_partkey) - 1 + case when e.stem is null then 0 else 1 end as r from v left join e on v.stem = e.stem where p_partkey % 2 = 1),
t as (select regexp_extract(stem, {_NUMBERED}, 1) as base, list(distinct cast(regexp_extract(stem, {_NUMBERED}, 2) as bigint)) as l from v where regexp_matches(stem, {_NUMBERED}) group by 1)
select p_partkey, case when r = 0 then n.stem else n.stem || '_' || list_filter(range(1, r + 2 + coalesce(len(l), 0)), lambda i: not list_contains(coalesce(l, []), i))[r] end || '.zip' as unique_dest from n left join t on base = n.stem""")
def names_across_runs(spark, sf_dir):
    """Names for the odd parts; those of the even ones were given by an earlier run."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr(_ASKED), F.lit(".zip")).alias("dest"))
    stem, end = lambda x: F.regexp_replace(x, r"\.zip$", ""), lambda _: F.lit(".zip")
    return dedupe.unique_names(rows.where("p_partkey % 2 = 1"), "dest", ["p_partkey"], stem, end, rows.where("p_partkey % 2 = 0").select("dest")).select("p_partkey", "unique_dest")


@query("""select '/t/' || p_partkey || '.zip' as path_key, cast(p_size + case when p_partkey % 7 = 0 then 1 else 0 end as bigint) as size_bytes,
    case when p_partkey % 7 = 0 then 'new' else 'old' end as xxh64, 'ok' as status from part where p_partkey % 11 <> 0""")
def index_upserts(spark, sf_dir):
    """A target index published, then brought up to date: changed files, and files that are gone."""
    root, key = state.scratch(spark, "index"), F.col("p_partkey")
    files = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/t/"), key.cast("string"), F.lit(".zip")).alias("path_key"), F.col("p_size").cast("long").alias("size_bytes"), key.alias("mtime_ns"))
    hashed = lambda x: files.select("path_key", F.lit(x).alias("xxh64"), F.lit("").alias("note"))
    listing = files.drop("p_partkey")
    index_sync.publish_changes(spark, root, listing, hashed("old"))
    now = files.where("p_partkey % 11 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(key % 7 == 0, 1).otherwise(0)).drop("p_partkey")
    index_sync.publish_changes(spark, root, now, hashed("new"))
    return buckets.read(spark, root, index_sync.INDEX).select("path_key", "size_bytes", "xxh64", "status")


def _streamed(spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """``run`` over ``rows`` as a stream, written and read back once it is used up."""
    place = state.scratch(spark, "stream")
    rows.write.parquet(f"{place}/in")
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")  # else timers keep the query going
    try:
        out = run(spark.readStream.schema(rows.schema).parquet(f"{place}/in"))
        out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(empty, before)
    return spark.read.schema(schema).parquet(f"{place}/out")


@query("""select action, count(*) as n, cast(sum(n_seen) as bigint) as children, cast(sum(packed) as bigint) as packed from (
    select o_custkey, count(*) as n_seen, count(*) filter (where o_orderkey % 3 = 0 and o_orderkey % 2 = 0) as packed, case when bool_or(o_orderkey % 3 = 0) then 'delete_eligible' else 'move_nobook' end as action
    from orders group by o_custkey having o_custkey % 5 <> 0) group by action""")
def archives_streamed(spark, sf_dir):
    """Customers as archives and their orders as children; every fifth waits for a child for ever."""
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    children = orders.select("o_custkey", "o_orderkey", (key % 3 == 0).alias("is_book"), F.when(key % 3 != 0, "nobook").when(key % 2 == 0, "packed").otherwise("failed").alias("result"), F.lit(1).alias("size_bytes"))
    sizes = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    waits = F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0)
    events = keyed.announcements(sizes, "o_custkey", F.col("n") + waits).unionByName(keyed.results(children, "o_custkey", key.cast("string")))
    told = _streamed(spark, events.withColumn("archive_source", F.col("archive_source").cast("string")), keyed.complete_archives, keyed.CLOSED)
    return told.groupBy("action").agg(F.count("*").alias("n"), F.sum("n_seen").alias("children"), F.sum("book_packed").alias("packed"))


@query("""with h as (select doc_id, md5(text) as h from documents), known as (select distinct h from h where doc_id % 10 = 0),
c as (select h.h, count(*) as n, case when known.h is null then 1 else 0 end as fresh from h left join known on h.h = known.h group by h.h, known.h)
select 'unique' as status, cast(sum(fresh) as bigint) as n from c union all select 'duplicate', cast(sum(n - fresh) as bigint) from c""")
def first_writers_streamed(spark, sf_dir):
    """Documents as arriving files; every tenth is in the published index already."""
    rows = read(spark, sf_dir, "documents").select(F.md5("text").alias("xxh64"), F.col("doc_id").cast("string").alias("path"))
    known = rows.where(F.col("path").cast("long") % 10 == 0).select("xxh64", F.col("path").alias("canonical_zip"))
    told = _streamed(spark, rows, lambda stream: keyed.first_writers(stream, "xxh64", "path", known), "xxh64 string, path string, status string, canonical string")
    return told.groupBy("status").agg(F.count("*").alias("n"))
