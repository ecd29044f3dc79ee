"""The queries of this engine's own operators over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import default_stopwords
from ..operators import augment, clean, linking, parsers, patterns, search
from ..sources import files
from ..streaming import search as streaming
from .shared import own_folder
from .validate import MENTION, validate

FREQUENT = [("a", "of the"), ("a", "and the"), ("b", "to the"), ("c", "in the"), ("c", "the of")]
PAIR = "([A-Za-z]+) ([A-Za-z]+)"
EDITS = [(10, 1), (16, 2)]
WORD1, WORD2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _found[f.__name__] = (f, sql)
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _benchmark_names(spark: SparkSession, d: str) -> DataFrame:
    """The first two plain words of every benchmark item."""
    return _read(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("uniqid"), F.regexp_extract("text", PAIR, 0).alias("search_name"))


def _frequent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, n, k) for k, (u, n) in enumerate(FREQUENT)], "uniqid string, search_name string, k int")


LONG = ["doc_id", "uniqid", "match", "start_at", "end_at"]


def _long(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc").cast("long").alias("doc_id"), "uniqid", "match", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


def _mentions_sql(names: str, docs: str = "SELECT doc_id AS id, text FROM documents") -> str:
    """CTEs up to ``m`` (id, uid, us, ks, kw, s, e); non-ASCII letters are masked, as names are ASCII and RE2's boundaries know no others."""
    return rf"""WITH names AS ({names}), docs AS (SELECT id, lower(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')) AS t FROM ({docs})),
    c AS (SELECT id, uid, us, ks, kw, string_split_regex(t, '\b' || kw || '\b') AS parts FROM docs JOIN names ON contains(t, kw) WHERE kw <> ''),
    u AS (SELECT id, uid, us, ks, kw, parts, unnest(range(1, len(parts))) AS i FROM c WHERE len(parts) > 1),
    m AS (SELECT id, uid, us, ks, kw, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(kw) AS BIGINT) AS s,
                 CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * length(kw) AS BIGINT) AS e FROM u)"""


BENCHMARK_SQL = f"SELECT CAST(item_id AS VARCHAR) AS uid, item_id AS us, 0 AS ks, lower(regexp_extract(text, '{PAIR}', 0)) AS kw FROM benchmark"
FREQUENT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{u}', {'abc'.index(u)}, {k}, '{n}')" for k, (u, n) in enumerate(FREQUENT)) + ") v(uid, us, ks, kw)"


@query(_mentions_sql(BENCHMARK_SQL) + " SELECT id AS doc_id, uid AS uniqid, kw AS match, s AS start_at, e AS end_at FROM m")
def search_exact_mentions(spark, d):
    return _long(search.mentions(_read(spark, d, "documents"), _benchmark_names(spark, d), "doc_id", order="item_id", max_results=None))


@query(_mentions_sql(BENCHMARK_SQL) + " SELECT uid AS uniqid, count(*) AS mentions, count(DISTINCT id) AS documents FROM m GROUP BY uid")
def search_exact_counts(spark, d):
    found = search.mentions(_read(spark, d, "documents"), _benchmark_names(spark, d), "doc_id", order="item_id", max_results=None)
    return found.groupBy("uniqid").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc").alias("documents"))


CAPPED = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, ks, s) AS r FROM m"


@query(_mentions_sql(FREQUENT_SQL) + f" SELECT id AS doc_id, uid AS uniqid, kw AS match, s AS start_at, e AS end_at FROM ({CAPPED}) WHERE r <= 5")
def search_topk_capped(spark, d):
    return _long(search.mentions(_read(spark, d, "documents"), _frequent(spark), "doc_id", order="k", max_results=5))


@query(_mentions_sql(FREQUENT_SQL) + " SELECT id AS doc_id, uid AS uniqid, count(*) AS n, string_agg(kw, ';' ORDER BY s, e) AS match, string_agg(s, ';' ORDER BY s, e) AS start_at, string_agg(e, ';' ORDER BY s, e) AS end_at FROM m GROUP BY id, uid")
def search_grouped(spark, d):
    g = search.grouped(search.mentions(_read(spark, d, "documents"), _frequent(spark), "doc_id", order="k", max_results=None))
    return g.select(F.col("doc").alias("doc_id"), "uniqid", "n", "match", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def _wide_sql(join: str) -> str:
    cells = ", ".join(f"coalesce(max(CASE WHEN r = {i} THEN {c} END), '') AS name{i}_{n}" for i in (1, 2, 3) for n, c in (("uniqid", "uid"), ("match", "kw"), ("start", "CAST(s AS VARCHAR)")))
    return _mentions_sql(FREQUENT_SQL) + f", k AS (SELECT * FROM ({CAPPED}) WHERE r <= 3) SELECT doc_id, {cells}, count(r) AS n FROM documents {join} k ON doc_id = id GROUP BY doc_id"


def _wide(spark, d, keep_empty):
    docs = _read(spark, d, "documents")
    w = search.wide(docs, search.mentions(docs, _frequent(spark), "doc_id", order="k", max_results=3), "doc_id", ["doc_id"], 3, ["uniqid", "match", "start", "count"], keep_empty)
    return w.select("doc_id", *[F.col(f"`name{i}.{f}`").alias(f"name{i}_{f}") for i in (1, 2, 3) for f in ("uniqid", "match", "start")], F.col("count").cast("long").alias("n"))


@query(_wide_sql("JOIN"))
def search_wide(spark, d):
    return _wide(spark, d, False)


@query(_wide_sql("LEFT JOIN"))
def search_keep_empty(spark, d):
    return _wide(spark, d, True)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(c: str) -> str:
    """The cleaning chain over the expression ``c``."""
    import string

    special = _sql_text("".join(sorted(set(string.punctuation) - set(".,?"))))
    a, b, gone = T._accents()
    plain = rf"regexp_replace(translate(translate(lower({c}), {special}, ''), {_sql_text(a + gone)}, {_sql_text(b)}), '[\x{{80}}-\x{{FF}}]', '', 'g')"
    stop = "[" + ", ".join(map(_sql_text, default_stopwords())) + "]"
    kept = rf"array_to_string(list_filter(regexp_extract_all({plain}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+'), lambda x: NOT list_contains({stop}, x)), ' ')"
    return rf"trim(regexp_replace(translate({kept}, {_sql_text(string.punctuation)}, ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
def text_normalize_chain(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


CLEAN_NAMES = [("x", "of shall"), ("y", "onnd there"), ("z", "el la")]


@query(_mentions_sql("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {k}, 0, '{n}')" for k, (u, n) in enumerate(CLEAN_NAMES)) + ") v(uid, us, ks, kw)", f"SELECT doc_id AS id, {_clean_sql('text')} AS text FROM documents") + " SELECT id AS doc_id, uid AS uniqid, kw AS match, s AS start_at, e AS end_at FROM m")
def search_clean_text(spark, d):
    names = spark.createDataFrame([(u, n, k) for k, (u, n) in enumerate(CLEAN_NAMES)], "uniqid string, search_name string, k int")
    return _long(search.mentions(_read(spark, d, "documents"), names, "doc_id", order="k", max_results=None, clean=True))


def _fuzzy_sql() -> str:
    """Names over a length against the word-aligned windows of their length and two edits more or less; the others exactly.

    Characters that aren't ASCII are masked, letters and digits by one sign, others by another, as edit distance counts bytes here.
    """
    size = "CASE WHEN length(kw) > 16 THEN 2 WHEN length(kw) > 10 THEN 1 ELSE 0 END"
    exact = _mentions_sql(BENCHMARK_SQL).replace("WITH names", "WITH RECURSIVE names", 1)
    return exact + rf""", masked AS (SELECT doc_id AS id, regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{{L}}\p{{N}}]', chr(2), 'g'), '[^\x00-\x7F]', chr(1), 'g') AS t FROM documents),
    w AS (SELECT id, t, regexp_extract_all(t, '[a-z0-9_\x01]+') AS words, string_split_regex(t, '[a-z0-9_\x01]+') AS gaps FROM masked),
    a AS (SELECT id, t, list_transform(words, lambda x: length(x)) AS ws, list_transform(gaps, lambda x: length(x)) AS gs FROM w),
    p AS (SELECT id, t, unnest(range(1, len(ws) + 1)) AS i, ws, gs FROM a),
    q AS MATERIALIZED (SELECT id, t, i, CAST(coalesce(list_sum(ws[1:i - 1]), 0) + list_sum(gs[1:i]) AS BIGINT) AS s, ws[i] AS n FROM p),
    long AS (SELECT uid, us, kw, {size} AS k, length(kw) AS n FROM names WHERE {size} > 0),
    win AS MATERIALIZED (SELECT b.id, b.s AS s, e.s + e.n AS e, substring(b.t, b.s + 1, e.s + e.n - b.s) AS part FROM q b JOIN q e ON b.id = e.id AND e.i BETWEEN b.i AND b.i + 12 WHERE e.s + e.n - b.s BETWEEN (SELECT min(n - k) FROM long) AND (SELECT max(n + k) FROM long)),
    fit AS (SELECT win.id, uid, us, kw, s, e, levenshtein(part, kw) AS d FROM win JOIN long ON e - s BETWEEN n - k AND n + k WHERE levenshtein(part, kw) <= k),
    f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, uid ORDER BY d, s, e) AS r FROM fit),
    g AS (SELECT id, uid, s, e, d, r, TRUE AS taken, [{{'s': s, 'e': e}}] AS have FROM f WHERE r = 1
          UNION ALL SELECT f.id, f.uid, f.s, f.e, f.d, f.r, len(list_filter(have, lambda h: NOT (f.e <= h.s OR f.s >= h.e))) = 0,
                 CASE WHEN len(list_filter(have, lambda h: NOT (f.e <= h.s OR f.s >= h.e))) = 0 THEN list_append(have, {{'s': f.s, 'e': f.e}}) ELSE have END FROM g JOIN f ON f.id = g.id AND f.uid = g.uid AND f.r = g.r + 1)
    SELECT doc_id, uid AS uniqid, lower(substring(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))) AS match, s AS start_at, e AS end_at, CAST(d AS INTEGER) AS distance FROM g JOIN documents ON doc_id = id WHERE taken
    UNION ALL SELECT id, uid, kw, s, e, 0 FROM m WHERE {size} = 0"""


@query(_fuzzy_sql())
def search_fuzzy(spark, d):
    found = search.mentions(_read(spark, d, "documents"), _benchmark_names(spark, d), "doc_id", order="item_id", max_results=None, edits=EDITS)
    return found.select(F.col("doc").cast("long").alias("doc_id"), "uniqid", "match", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "distance")


def _apart_sql() -> str:
    """Of the mentions of a uid in a text, from left to right, those that don't begin within the last one taken."""
    m = _mentions_sql(FREQUENT_SQL).replace("WITH names", "WITH RECURSIVE names", 1)
    return m + """, x AS MATERIALIZED (SELECT id, uid, kw, s, e, row_number() OVER (PARTITION BY id, uid ORDER BY s, ks) AS n FROM m),
    g AS (SELECT id, uid, kw, s, e, n, TRUE AS taken, e AS reach FROM x WHERE n = 1
          UNION ALL SELECT x.id, x.uid, x.kw, x.s, x.e, x.n, x.s >= reach, CASE WHEN x.s >= reach THEN x.e ELSE reach END FROM g JOIN x ON x.id = g.id AND x.uid = g.uid AND x.n = g.n + 1)
    SELECT id AS doc_id, uid AS uniqid, kw AS match, s AS start_at, e AS end_at FROM g WHERE taken"""


@query(_apart_sql())
def search_without_overlaps(spark, d):
    return _long(search.mentions(_read(spark, d, "documents"), _frequent(spark), "doc_id", order="k", max_results=None, overlap="per_uid"))


@query(_mentions_sql(FREQUENT_SQL, "SELECT conv_id * 1000 + turn AS id, text FROM conversations") + " SELECT id, uid AS uniqid, count(*) AS n FROM m GROUP BY id, uid")
def search_conversations(spark, d):
    turns = _read(spark, d, "conversations").withColumn("id", F.expr("conv_id * 1000 + turn"))
    return search.mentions(turns, _frequent(spark), "id", order="k", max_results=None).groupBy(F.col("doc").alias("id"), "uniqid").agg(F.count(F.lit(1)).alias("n"))


def _part_names(spark, d):
    """'B, a q & A, b' for part 'a b': two names to a cell, the first with a middle initial."""
    return _read(spark, d, "part").select("p_partkey", F.expr(f"concat(upper({WORD2}), ', ', {WORD1}, ' q & ', upper({WORD1}), ', ', {WORD2})").alias("Name"), F.col("p_brand").alias("seat"))


NAMES_SQL = f"SELECT p_partkey, p_brand AS seat, 0 AS f, upper({WORD1}) AS a, 'Q.' AS mid, upper({WORD2}) AS b FROM part UNION ALL SELECT p_partkey, p_brand, 1, upper({WORD2}), '', upper({WORD1}) FROM part"


def _cleaned(spark, d, keep_all):
    c = clean.clean_names(_part_names(spark, d), order="p_partkey", keep_all=keep_all)
    return c.select("p_partkey", "seat", "uniqid", "FirstName", F.col("`MiddleInitial/Name`").alias("MiddleName"), "LastName")


@query(f"SELECT p_partkey, seat, row_number() OVER (ORDER BY p_partkey, f) AS uniqid, a AS FirstName, mid AS MiddleName, b AS LastName FROM ({NAMES_SQL})")
def clean_names_parse(spark, d):
    return _cleaned(spark, d, True)


FIRST_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, mid, b ORDER BY p_partkey, f) AS nth FROM ({NAMES_SQL})) WHERE nth = 1"


@query(f"SELECT p_partkey, seat, row_number() OVER (ORDER BY p_partkey, f) AS uniqid, a AS FirstName, mid AS MiddleName, b AS LastName FROM ({FIRST_SQL})")
def clean_names_dedup(spark, d):
    return _cleaned(spark, d, False)


PREFIXES = [(0, "Brand#11", "Mr;Sir"), (1, "Brand#12", "Dr"), (2, "Brand#11", "Gov;Mayor"), (3, "Brand#21", "Rep")]


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{k}', '{v}')" for o, k, v in PREFIXES) + ") v(o, k, v)), l AS (SELECT k, arg_max(v, o) AS v FROM p GROUP BY k) SELECT p_partkey, p_brand, coalesce(v, '') AS prefixes FROM part LEFT JOIN l ON p_brand = k")
def augment_prefix_lookup(spark, d):
    rows = spark.createDataFrame(PREFIXES, "o int, p_brand string, prefixes string")
    return augment.augment_names(_read(spark, d, "part").select("p_partkey", "p_brand"), augment.prefix_table(rows, "p_brand", order="o"), prefix_column="p_brand").drop("nick_names")


NICKS = [(0, "Small, tiny - Smally, sm"), (1, "large - Larry, l"), (2, "small - other"), (3, "no dash"), (4, "red, green - colour")]


@query(f"SELECT p_partkey, {WORD1} AS FirstName, CASE {WORD1} WHEN 'small' THEN 'smally;sm' WHEN 'tiny' THEN 'smally;sm' WHEN 'large' THEN 'larry;l' WHEN 'red' THEN 'colour' WHEN 'green' THEN 'colour' ELSE '' END AS nick_names FROM part")
def augment_nickname_lookup(spark, d):
    lines = spark.createDataFrame(NICKS, "o int, value string")
    names = _read(spark, d, "part").selectExpr("p_partkey", f"{WORD1} AS FirstName")
    return augment.augment_names(names, nicknames=augment.nickname_table(lines, order="o")).drop("prefixes")


def _to_expand(spark, d):
    return _read(spark, d, "part").selectExpr("p_partkey", f"upper({WORD1}) AS FirstName", f"{WORD2} AS LastName", "CASE WHEN p_size % 2 = 0 THEN 'Mr;Dr' ELSE '' END AS prefixes", f"concat(left({WORD1}, 2), ';', left({WORD1}, 3)) AS nick_names")


EXPANDED_SQL = f"""SELECT p_partkey, 0 AS pat_ord, 0 AS prod_ord, {WORD1} || ' ' || {WORD2} AS search_name FROM part
    UNION ALL SELECT p_partkey, 1, n, left({WORD1}, n + 2) || ' ' || {WORD2} FROM part, (VALUES (0), (1)) v(n)
    UNION ALL SELECT p_partkey, 2, n, p || ' ' || {WORD2} FROM part, (VALUES (0, 'Mr'), (1, 'Dr')) v(n, p) WHERE p_size % 2 = 0"""


@query(EXPANDED_SQL)
def pattern_expand(spark, d):
    return patterns.expand(_to_expand(spark, d)).select("p_partkey", "pat_ord", "prod_ord", "search_name")


DROP = ["Small Ring", "mr box", "la case"]


@query(f"SELECT * FROM ({EXPANDED_SQL}) WHERE lower(search_name) NOT IN ({', '.join(_sql_text(x.lower()) for x in DROP)})")
def pattern_drop_list(spark, d):
    listed = spark.createDataFrame([(x,) for x in DROP], "search_name string")
    return patterns.drop_listed(pattern_expand(spark, d), listed)


def _sized(spark, d):
    return _read(spark, d, "part").selectExpr("p_partkey", "concat(p_name, ' ', p_size) AS search_name")


@query("SELECT min(p_partkey) AS p_partkey, p_name || ' ' || p_size AS search_name FROM part GROUP BY 2 HAVING count(DISTINCT p_partkey) = 1")
def pattern_dedup_exact(spark, d):
    return patterns.dedup_exact(_sized(spark, d), ["p_partkey"], "p_partkey")


def _dedup_fuzzy_sql() -> str:
    size = "CASE WHEN length(name) > 16 THEN 2 WHEN length(name) > 10 THEN 1 ELSE 0 END"
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey, p_name || ' ' || p_size AS name, p_partkey AS u FROM part),
    near AS MATERIALIZED (SELECT a.i, list(b.i) AS later, bool_or(a.u <> b.u) AS other FROM r a JOIN r b ON a.i < b.i AND abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) <= (CASE WHEN length(a.name) > 16 THEN 2 WHEN length(a.name) > 10 THEN 1 ELSE 0 END) GROUP BY a.i),
    st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS struck
           UNION ALL SELECT st.i + 1, CASE WHEN n.i IS NULL OR list_contains(struck, st.i + 1) THEN struck ELSE list_distinct(list_concat(struck, n.later, CASE WHEN n.other THEN [-n.i] ELSE [] END)) END FROM st LEFT JOIN near n ON n.i = st.i + 1 WHERE st.i < (SELECT count(*) FROM r))
    SELECT p_partkey, name AS search_name FROM r, (SELECT struck FROM st ORDER BY i DESC LIMIT 1) WHERE NOT list_contains(struck, r.i) AND NOT list_contains(struck, -r.i)"""


@query(_dedup_fuzzy_sql())
def pattern_dedup_fuzzy(spark, d):
    return patterns.dedup_fuzzy(_sized(spark, d), "p_partkey", EDITS, "p_partkey")


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT name, CASE WHEN length(name) > 9 THEN 3 WHEN length(name) > 7 THEN 2 ELSE 0 END AS k FROM n) SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS d FROM k a JOIN n b ON a.name <> b.name AND levenshtein(a.name, b.name) <= a.k")
def fuzzy_name_pairs(spark, d):
    n = _read(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    return patterns.near_pairs(n, n, [(7, 2), (9, 3)]).where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").cast("int").alias("d"))


def _accents_sql() -> str:
    a, b, gone = T._accents()
    return rf"SELECT doc_id, regexp_replace(translate(text, {_sql_text(a + gone)}, {_sql_text(b)}), '[\x{{80}}-\x{{FF}}]', '', 'g') AS plain FROM documents"


@query(_accents_sql())
def text_remove_accents(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.remove_accents(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'), lambda x: NOT list_contains([" + ", ".join(map(_sql_text, default_stopwords())) + "], x)), ' ') AS kept FROM documents")
def text_stopwords(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.remove_stopwords(F.col("text")).alias("kept"))


@query()
def text_stem(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.stemmed(F.col("text")).alias("porter"), T.stemmed(F.col("text"), True).alias("porter2"))


def _sentences_sql() -> str:
    keep = "|".join(T.SENTENCE_KEEPERS)
    blank = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '(?i)\b({keep})\.({blank})', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
    p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?][''"]?)({blank}+)', '\1' || chr(2) || '\2', 'g'), chr(2)) AS parts FROM m)
    SELECT doc_id, CAST(len(parts) AS INTEGER) AS sentences, array_to_string(list_transform(range(0, len(parts)), lambda i: CAST(coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) AS BIGINT)), ';') AS offsets FROM p"""


@query(_sentences_sql())
def text_split_sentences(spark, d):
    s = T.split_sentences(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(s["sentences"]).alias("sentences"), F.array_join(s["offsets"].cast("array<string>"), ";").alias("offsets"))


CONTEXT_NAMES = ["that the", "there"]


def _context_sql() -> str:
    names = ", ".join(f"('{n}')" for n in CONTEXT_NAMES)
    signs = " OR ".join(f"contains(lower(ctx), {_sql_text(s)})" for s in T.PERSON_SIGNS)
    return f"""WITH c AS (SELECT doc_id, text, name, string_split(lower(text), name) AS parts FROM documents JOIN (VALUES {names}) v(name) ON contains(lower(text), name)),
    u AS (SELECT *, unnest(range(1, len(parts))) AS i FROM c), s AS (SELECT doc_id, text, name, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(name) AS BIGINT) AS start_at FROM u),
    k AS (SELECT doc_id, name, start_at, substring(text, greatest(0, start_at - 50) + 1, least(length(text), start_at + length(name) + 50) - greatest(0, start_at - 50)) AS ctx FROM s)
    SELECT doc_id, name, start_at, ctx, ({signs}) AS person FROM k"""


@query(_context_sql())
def kwic_context(spark, d):
    f = linking.in_context(_read(spark, d, "documents"), CONTEXT_NAMES)
    return f.select(F.col("doc").alias("doc_id"), "name", F.col("start").cast("long").alias("start_at"), F.col("context").alias("ctx"), "person")


@query(r"SELECT doc_id, count(*) AS n, min(e) AS first_entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}''-]+(?: \p{Lu}[\p{L}''-]+)+')) AS e FROM documents) GROUP BY doc_id")
def entity_counts(spark, d):
    e = linking.entities(_read(spark, d, "documents").select("doc_id", "text"))
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first_entity"))


@query(f"""SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_name END AS linked, CAST(CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence,
    CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'none' END AS method FROM part""")
def entity_link_exact_normalized(spark, d):
    part = _read(spark, d, "part")
    kb = part.select(F.col("p_name").alias("canonical"), F.array(F.concat(F.lit("alias of "), "p_name")).alias("aliases")).distinct()
    m = part.select("p_partkey", F.expr("CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), '. ') ELSE concat('no ', p_name) END").alias("entity"))
    return linking.link(m, linking.link_index(kb)).select("p_partkey", "linked", "confidence", "method")


def _routed(spark, d):
    return _read(spark, d, "part").selectExpr("p_partkey", "concat(p_name, CASE WHEN p_size % 5 = 0 THEN ' Kumar' ELSE '' END) AS name")


COSINE = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(f"SELECT a.vec_id AS id, b.vec_id AS other, {COSINE} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COSINE} >= 0.4")
def similar_vectors_threshold(spark, d):
    return linking.similar(_read(spark, d, "embeddings"), least=0.4)


@query(f"SELECT id, other, similarity, rank FROM (SELECT id, other, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS other, {COSINE} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 5")
def entity_link_semantic_topk(spark, d):
    return linking.similar(_read(spark, d, "embeddings"), k=5)


@query(f"""SELECT CASE WHEN regexp_matches(lower(p_name), '{"|".join(parsers.INDIAN)}') THEN 'model' ELSE 'rule' END AS parser_used, count(*) AS total, avg(CASE WHEN regexp_matches(lower(p_name), '{"|".join(parsers.INDIAN)}') THEN 0.8 ELSE 1.0 END::DOUBLE) AS avg_confidence,
    min(CASE WHEN regexp_matches(lower(p_name), '{"|".join(parsers.INDIAN)}') THEN 0.8 ELSE 1.0 END::DOUBLE) AS min_confidence, count(*) AS confident, count(*) AS complete FROM (SELECT p_name || CASE WHEN p_size % 5 = 0 THEN ' Kumar' ELSE '' END AS p_name FROM part) GROUP BY 1""")
def parser_routing_stats(spark, d):
    return parsers.parsing_stats(parsers.parse_frame(_routed(spark, d), "name")).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("SELECT p_partkey, p_size BETWEEN 6 AND 40 AS ok, array_to_string(list_filter([CASE WHEN p_size - 10 < -4 THEN 'start' END, CASE WHEN NOT p_size <= 40 THEN 'end' END], lambda x: x IS NOT NULL), ';') AS errors FROM part")
def validate_rows(spark, d):
    rules = {"start": "p_size - 10 >= -4", "end": "p_size <= 40"}
    good, bad = validate(_read(spark, d, "part").select("p_partkey", "p_size"), rules)
    return good.select("p_partkey", F.lit(True).alias("ok"), F.lit("").alias("errors")).union(bad.select("p_partkey", F.lit(False), F.array_join("errors", ";")))


@query(_mentions_sql(FREQUENT_SQL) + " SELECT count(*) FILTER (s >= 400) AS good, count(*) FILTER (s < 400) AS bad FROM m")
def validate_mentions(spark, d):
    m = search.mentions(_read(spark, d, "documents"), _frequent(spark), "doc_id", order="k", max_results=None).withColumnRenamed("match", "text").withColumn("start", F.expr("start - 400"))
    good, bad = validate(m, MENTION)
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))


@query("SELECT conf >= 0.9 AS confident, count(*) AS n, round(avg(conf), 9) AS mean FROM (SELECT CASE WHEN regexp_matches(lower(p_name), '" + "|".join(parsers.INDIAN) + "') THEN 0.8 ELSE 1.0 END::DOUBLE AS conf FROM (SELECT p_name || CASE WHEN p_size % 5 = 0 THEN ' Kumar' ELSE '' END AS p_name FROM part)) GROUP BY 1")
def confidence_report(spark, d):
    return parsers.confidence_split(parsers.parse_frame(_routed(spark, d), "name"), 0.9).withColumn("mean", F.round("mean", 9))


@query("SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS chunk_id, doc_id, printf('chunk_%02d/part', CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT)) AS chunk FROM documents")
def split_corpus_chunks(spark, d):
    docs = _read(spark, d, "documents").select("doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return files.chunked(docs, 100, "doc_id").select("chunk_id", "doc_id", T.chunk_file(F.col("chunk_id"), "part").alias("chunk"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def merge_chunks_union(spark, d):
    docs = _read(spark, d, "documents")
    some = [docs.where(F.col("lang") == x) for x in ("en", "de")] + [docs.where(~F.col("lang").isin("en", "de") | F.col("lang").isNull()).drop("source")]
    return files.merge_tables(some).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(_mentions_sql(FREQUENT_SQL) + f" SELECT (SELECT count(*) FROM documents) AS total_rows, count(DISTINCT id) AS total_results, TRUE AS timed FROM m")
def processing_stats(spark, d):
    got = search.search_to(_read(spark, d, "documents"), _frequent(spark), f"{own_folder(spark)}/found", "doc_id", "text", 5, ["doc_id"], order="k")
    return spark.createDataFrame([(got["total_rows"], got["total_results"], got["rows_per_second"] > 0)], "total_rows long, total_results long, timed boolean")


@query(_mentions_sql(FREQUENT_SQL) + " SELECT id AS doc_id, uid AS uniqid, kw AS match, s AS start_at, e AS end_at FROM m")
def stream_search_file(spark, d):
    base = own_folder(spark)
    path = f"{d}/documents.parquet"
    stream = streaming.read_stream(spark, f"{d}/document[s].parquet", spark.read.parquet(path).schema)  # a pattern stands for a file or a folder
    streaming.search_stream(stream, _frequent(spark), f"{base}/out", f"{base}/state", doc_id="doc_id", order="k", max_results=None).awaitTermination()
    return _long(spark.read.parquet(f"{base}/out"))


#: Shapes of raw names, by part key: the cell, and the parts that come of it, of its first word {a} and its second {b}.
SHAPES = [
    ("{b}, {a} q JR", "{a}", "Q.", "{b}", "", "", "JR."),
    ("{b}, {a} sargent, JR.", "{a}", "SARGENT", "{b}", "", "", "JR."),
    ("{a} {b} (known as x)", "{a}", "", "{b}", "", "", ""),
    ("{a} 'nick' {b}", "{a}", "", "{b}", "", "", ""),
    ('{a} "nick, name" {b}', "{a}", "", "{b}", "", "", ""),
    ("Dr. {a} {b}", "{a}", "", "{b}", "", "DR.", ""),
    ("{b}, {a} III", "{a}", "", "{b}", "III", "", ""),
    ("{b}, {a} q V", "{a}", "Q.", "{b}", "V", "", ""),
    ("{b}, {a} q mr", "{a}", "Q.", "{b}", "", "MR", ""),
    ("POPE {a} {b}", "POPE {a}", "", "{b}", "", "", ""),
    ("{a} {b} PhD", "{a}", "", "{b}", "", "", "PHD."),
    ("{a} r van der {b}", "{a}", "R.", "van der {b}", "", "", ""),
    ("{a} b. c. {b} Sr.", "{a}", "B. C.", "{b}", "", "", "SR."),
    ("BARON {a} {b} & Prof. {b} {a}", "BARON {a}", "", "{b}", "", "", ""),
]


def _filled(shape: str) -> str:
    """SQL of a shape, of upper-case words."""
    return f"replace(replace({_sql_text(shape)}, '{{a}}', upper({WORD1})), '{{b}}', upper({WORD2}))"


def _by_shape(k: int) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(SHAPES)} = {i} THEN {_filled(x[k])}" for i, x in enumerate(SHAPES)) + " END"


SHAPED = ["FirstName", "MiddleName", "LastName", "RomanNumeral", "Title", "Suffix"]
BARON = len(SHAPES) - 1
SHAPES_SQL = "SELECT p_partkey, 0 AS f, " + ", ".join(f"{_by_shape(k + 1)} AS {n}" for k, n in enumerate(SHAPED)) + f" FROM part UNION ALL SELECT p_partkey, 1, upper({WORD2}), '', upper({WORD1}), '', 'PROF.', '' FROM part WHERE p_partkey % {len(SHAPES)} = {BARON}"


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY p_partkey, f) AS uniqid, {', '.join(SHAPED)} FROM ({SHAPES_SQL})")
def clean_names_rules(spark, d):
    raw = _read(spark, d, "part").select("p_partkey", F.expr(_by_shape(0)).alias("Name"))
    c = clean.clean_names(raw, order="p_partkey", keep_all=True)
    return c.select("p_partkey", "uniqid", "FirstName", F.col("`MiddleInitial/Name`").alias("MiddleName"), *SHAPED[2:])


LOOSE_SQL = f"SELECT DISTINCT upper(left({WORD1}, 1)) || substr({WORD1}, 2) AS FirstName, '' AS MiddleName, upper(left({WORD2}, 1)) || substr({WORD2}, 2) AS LastName, 'Mr.' AS Prefix FROM part WHERE p_size % 10 <> 0"


def _loose(parts):
    return parts.selectExpr("CASE WHEN p_size % 10 = 0 THEN '  ' ELSE concat('MR.  ', upper(p_name), ' ') END AS Name")


@query(LOOSE_SQL)
def clean_names_loose_form(spark, d):
    return clean.clean_names_loose(_loose(_read(spark, d, "part"))).select("FirstName", "MiddleName", "LastName", "Prefix")


@query(LOOSE_SQL)
def stream_clean_file(spark, d):
    base = own_folder(spark)
    stream = streaming.read_stream(spark, f"{d}/par[t].parquet", spark.read.parquet(f"{d}/part.parquet").schema)
    streaming.clean_stream(_loose(stream), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("FirstName", "MiddleName", "LastName", "Prefix")


@query(f"SELECT p_partkey, search_name FROM (SELECT *, row_number() OVER (PARTITION BY search_name ORDER BY p_partkey, pat_ord, prod_ord) AS nth, min(p_partkey) OVER (PARTITION BY search_name) AS lo, max(p_partkey) OVER (PARTITION BY search_name) AS hi FROM (SELECT p_partkey, pat_ord, prod_ord, search_name || ' ' || (p_partkey % 700) AS search_name FROM ({EXPANDED_SQL})) WHERE lower(search_name) NOT IN ({', '.join(_sql_text(x.lower() + ' 7') for x in DROP)})) WHERE nth = 1 AND lo = hi")
def preprocess_patterns(spark, d):
    names = _to_expand(spark, d).withColumn("LastName", F.expr("concat(LastName, ' ', p_partkey % 700)"))
    path = f"{own_folder(spark)}/drop"
    spark.createDataFrame([(f" {x} 7 ",) for x in DROP] + [("",)], "value string").write.text(path)
    return patterns.preprocess(names, drop=files.read_drop_list(spark, path), order="p_partkey", uid="p_partkey").select("p_partkey", "search_name")


def _parsed_sql(used: str) -> str:
    return f"CASE WHEN p_size % 5 = 0 THEN 'Kumar' ELSE {WORD2} END AS last_name, CASE WHEN p_size % 5 = 0 THEN {WORD2} END AS middle_name, {used}"


ROUTED = "p_size % 5 = 0 OR regexp_matches(p_name, '" + "|".join(parsers.INDIAN) + "')"


@query(f"SELECT p_partkey, first_name, middle_name, last_name, concat_ws(' ', first_name, middle_name, last_name) AS full_name, confidence, parser_used FROM (SELECT p_partkey, {WORD1} AS first_name, {_parsed_sql(f'CASE WHEN {ROUTED} THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence')}, CASE WHEN {ROUTED} THEN 'model' ELSE 'rule' END AS parser_used FROM part)")
def parse_names_frame(spark, d):
    p = parsers.parse_frame(_routed(spark, d), "name", components=False)
    j = F.from_json(parsers.as_json("parsed_name"), "first_name string, middle_name string, last_name string, confidence double, parser_used string")
    return p.select("p_partkey", j.alias("j"), parsers.full_name("parsed_name").alias("full_name")).select("p_partkey", "j.first_name", "j.middle_name", "j.last_name", "full_name", "j.confidence", "j.parser_used")


@query(f"SELECT p_partkey, k AS asked, CASE WHEN k = 'model' OR k = 'auto' AND ({ROUTED}) THEN 'model' ELSE 'rule' END AS parser_used, CASE WHEN k = 'model' OR k = 'auto' AND ({ROUTED}) THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM part, (VALUES ('auto'), ('model'), ('rule')) v(k)")
def parsers_compared(spark, d):
    c = parsers.compare_parsers(_routed(spark, d), "name")
    return c.select("p_partkey", "asked", "parsed.parser_used", "parsed.confidence")


@query(f"SELECT p_partkey, upper(p_name) AS parsed_last_name, CASE WHEN p_size % 4 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS parsed_confidence, CASE WHEN p_size % 4 = 0 THEN 'model' ELSE 'rule' END AS parser_used FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN p_name ELSE 'kumar' END AS p_name FROM part WHERE p_size % 2 = 0)")
def parse_by_model_threshold(spark, d):
    """A model that is less sure of some names than the threshold, which then go by the rules."""
    names = _read(spark, d, "part").where("p_size % 2 = 0").selectExpr("p_partkey", "concat(p_name, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE '  ' END, 'kumar') AS name")
    model = lambda some: [{"first": "x", "last": n.removesuffix(" kumar"), "confidence": 0.5 if "  " in n else 0.9} for n in some]
    return parsers.parse_frame(names, "name", model=model, batch_size=7, ml_threshold=0.8).select("p_partkey", F.upper("parsed_last_name").alias("parsed_last_name"), "parsed_confidence", "parser_used")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(c):
    return F.array(*[(F.length(c) - F.length(F.replace(F.lower(c), F.lit(x), F.lit("")))).cast("float") for x in LETTERS])


_LETTERS_SQL = lambda c: "[" + ", ".join(f"CAST(length({c}) - length(replace(lower({c}), '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"


@query(f"""WITH kb AS (SELECT DISTINCT p_name AS name FROM part), m AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || '!' WHEN 2 THEN p_name || ' ' || left(p_name, 3) ELSE 'qqq zzz' END AS e, p_size % 4 AS k FROM part),
    t AS (SELECT DISTINCT e FROM m WHERE k >= 2), v AS (SELECT e, round(list_cosine_similarity({_LETTERS_SQL('e')}, {_LETTERS_SQL('name')}), 6) AS s FROM t, kb), b AS (SELECT e, max(s) AS s, least(count(*) - 1, 5) AS others FROM v WHERE s >= 0.8 GROUP BY e)
    SELECT p_partkey, CASE WHEN k = 0 THEN 'exact' WHEN k = 1 THEN 'normalized' WHEN s IS NULL THEN 'none' ELSE 'semantic' END AS method, CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.9 ELSE coalesce(s, 0.0) END::DOUBLE AS confidence, CAST(CASE WHEN k < 2 THEN 0 ELSE coalesce(others, 0) END AS INTEGER) AS others FROM m LEFT JOIN b ON m.e = b.e AND k >= 2""")
def entity_link_cascade(spark, d):
    part = _read(spark, d, "part")
    m = part.selectExpr("p_partkey", "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), '!') WHEN 2 THEN concat(p_name, ' ', left(p_name, 3)) ELSE 'qqq zzz' END AS entity")
    kb = part.select(F.col("p_name").alias("canonical"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
    return linking.link_all(m, kb, _letters).select("p_partkey", "method", "confidence", F.size("alternatives").alias("others"))


@query(f"SELECT id, linked, similarity AS confidence, others FROM (SELECT id, first(other ORDER BY rank) AS linked, first(similarity ORDER BY rank) AS similarity, coalesce(string_agg(other, ';' ORDER BY rank) FILTER (rank > 1), '') AS others FROM (SELECT id, other, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS other, {COSINE} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0) WHERE similarity >= 0.2) WHERE rank <= 6 GROUP BY id)")
def entity_link_by_vector(spark, d):
    """Entries are the vectors that don't end in 0, mentions those that do: two tables of one."""
    e = _read(spark, d, "embeddings")
    f = linking.link_by_vector(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), 0.2)
    return f.select("id", "linked", "confidence", F.array_join(F.col("alternatives").cast("array<string>"), ";").alias("others"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_column(spark, d):
    e = _read(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query(f"SELECT p_partkey, {WORD1} || ';' || {WORD2} AS joined, CAST(4 AS INTEGER) AS pieces, {WORD2} AS second, {WORD1} || ' ' || {WORD2} AS plain, p_name AS squeezed FROM part")
def list_codec_and_sql_functions(spark, d):
    T.register(spark)
    given = _read(spark, d, "part").select("p_partkey", "p_name", F.expr(f"concat(' ', {WORD1}, ';;', {WORD2}, ' ; ')").alias("listed"))
    listed = T.split_list(F.col("listed"))
    return given.select("p_partkey", T.join_list(listed).alias("joined"), F.size(listed).alias("pieces"), F.trim(listed[2]).alias("second"), F.expr("qs_normalize_name(concat(upper(p_name), '!?'))").alias("plain"), F.expr("qs_remove_extra_space(concat('  ', replace(p_name, ' ', '   '), ' '))").alias("squeezed"))


@query(_context_sql() .replace("SELECT doc_id, name, start_at, ctx, (", "SELECT name, count(*) AS match_count, count(*) FILTER (") .replace(") AS person FROM k", ") AS person_matches FROM k GROUP BY name UNION ALL SELECT 'nobody at all', 0, 0"))
def kwic_counts(spark, d):
    names = [*CONTEXT_NAMES, "nobody at all"]
    return linking.context_counts(linking.in_context(_read(spark, d, "documents"), names), names)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || chr(10) || '\"x\", y' AS p_name, 2 AS n FROM part")
def csv_append_and_read(spark, d):
    """Written, appended to since it is there, overwritten by a new path with what was read, and merged with nothing else."""
    base, part = own_folder(spark), _read(spark, d, "part").selectExpr("p_partkey", "concat(p_name, char(10), '\"x\", y') AS p_name", "0.5 AS name_confidence")
    for _ in range(2):
        files.write_table(part, f"{base}/a.csv", overwrite=False, confidence=False)
    files.merge_files(spark, [f"{base}/a.csv"], f"{base}/b.csv")
    return files.read_table(spark, f"{base}/b.csv").groupBy("p_partkey", "p_name").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT format('rows_part{:03d}.csv', p // 300 + 1) AS file, count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p FROM part) GROUP BY 1")
def split_part_files(spark, d):
    base = f"{own_folder(spark)}/parts"
    files.split_rows(_read(spark, d, "part").select("p_partkey", "p_name").repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), base, 300)
    return files.read_parts(spark, base).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("p_partkey").cast("long")).alias("lo"), F.max(F.col("p_partkey").cast("long")).alias("hi"))


@query("SELECT line, count(*) AS n FROM (SELECT regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') AS line FROM documents) GROUP BY line")
def text_export_lines(spark, d):
    base, docs = own_folder(spark), _read(spark, d, "documents")
    for _ in range(2):  # the second time nothing is written
        files.export_text(docs, base, like="/corpora/en/docs.csv.gz", below="/corpora")
    return spark.read.text(f"{base}/en/docs").select(F.col("value").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n, sum(p_partkey)::BIGINT AS keys FROM part, (VALUES ('csv'), ('json'), ('parquet')) v(kind) GROUP BY kind")
def export_formats(spark, d):
    base, part, out = own_folder(spark), _read(spark, d, "part").select("p_partkey", "p_name", F.lit(0.5).alias("my_confidence")), []
    for kind in files.FORMATS[:3]:
        n = files.write_counted(part, f"{base}/t.{kind}", confidence=False)
        t = files.read_table(spark, f"{base}/t.{kind}")
        out.append(t.agg(F.lit(kind).alias("kind"), F.lit(n).cast("long").alias("n"), F.sum(F.col("p_partkey").cast("long")).alias("keys")).where(F.lit("my_confidence" not in t.columns)))
    return files.merge_tables(out)


@query(_mentions_sql(BENCHMARK_SQL) + " SELECT uid AS uniqid, count(*) AS n FROM m GROUP BY uid")
def search_from_name_file(spark, d):
    path = f"{own_folder(spark)}/names.csv"
    files.write_table(_benchmark_names(spark, d).select(F.col("uniqid").alias("id"), F.col("search_name").alias("who"), F.lit("x").alias("more")), path)
    found = search.mentions(_read(spark, d, "documents"), files.read_name_list(spark, path, "id", "who"), "doc_id", max_results=None)
    return found.groupBy("uniqid").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}
