import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillsift import cli
from quillsift.functions import names as N
from quillsift.functions import text as T
from quillsift.operators import augment, clean, linking, parsers, patterns, search
from quillsift.plans.config import Config
from quillsift.plans.shared import numbered, ranked
from quillsift.plans.validate import MENTION, validate
from quillsift.sources import files
from quillsift.streaming import search as streaming


def test_search_offsets_equal_those_of_plain_regex(spark):
    r = random.Random(1)
    bits = ["ann", "lee", "ann lee", "Ann", "é", "éann", ".", ", ", "\n", "🙂", "lee-ann", "x"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "uniqid long, text string")
    kws = [("1", "ann"), ("1", "ann lee"), ("2", "lee")]
    got = sorted((x.doc, x.uniqid, x.match, x.start, x.end) for x in search.mentions(docs, spark.createDataFrame([(u, k, i) for i, (u, k) in enumerate(kws)], "uniqid string, search_name string, o int"), order="o", max_results=None).collect())
    want = sorted((i, u, k, m.start(), m.end()) for i, t in enumerate(texts) for u, k in kws for m in re.finditer(rf"\b{re.escape(k)}\b", t, re.I))
    assert got == want and want


def test_search_fuzzy_against_windows(spark):
    e = search.create_engine([("1", "john smithson")], [(10, 1)])
    assert [(x["start"], x["end"]) for x in e.search("a jon smithson, John Smithson and joan smithsom")] == [(2, 14), (16, 29)]
    basic = search.create_engine([("1", "ann"), ("1", "ann lee")], strategy="basic")
    assert [x["match"] for x in basic.search("Ann Lee")] == ["ann"]
    with pytest.raises(ValueError):
        search.create_engine([], strategy="other")


@pytest.mark.parametrize("edits, overlap", [(None, "per_uid"), ([(10, 1)], "all")])
def test_search_gives_away_what_it_found(edits, overlap):
    import pyarrow as pa

    class Sent:
        value = [("1", "ann", 0, 0), ("1", "ann lee", 0, 1), ("2", "john smithson", 1, 0)]

    texts = ["ann lee and jon smithson, " * (i % 50) for i in range(2000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(2000), None]), pa.array(texts)], ["doc", "text"])
    parts = list(search._searcher(Sent, edits, overlap, None)([batch]))
    assert len(parts) > 1 and max(p.num_rows for p in parts) < search.MOST_ROWS + 200  # those of one text
    find, got = search.Finder(Sent.value, edits), [tuple(x.values()) for p in parts for x in p.to_pylist()]
    want = []
    for i, t in enumerate(texts[:-1]):
        hits = search._apart(find(t), Sent.value) if overlap == "per_uid" else find(t)
        want += sorted(((i, Sent.value[k][0], 1, t[s:e], s, e, *Sent.value[k][2:], d) for k, s, e, d in hits), key=lambda x: (x[0], x[6], x[7], x[4]))
    assert got == want and got


def test_row_numbers_are_dense_and_in_order(spark):
    d = spark.range(0, 5000, 3, 7).withColumn("k", F.col("id") * 100)
    assert [x.n for x in numbered(d, "n").orderBy("id").collect()] == list(range(d.count()))
    assert [x.n for x in ranked(d, "n", "k").orderBy("id").collect()] == list(range(1, d.count() + 1))
    assert ranked(d.limit(0), "n", "k").count() == 0


def test_cleaning_follows_its_rules(spark):
    raw = spark.createDataFrame([(1, "SMITH, John A Jr (Bob)"), (2, "Doe, Jane & Roe, Richard III"), (3, "doe, jane"), (4, "Smith, John Q IV"), (5, "Doe, Jane"), (6, None), (7, "")], "k long, Name string")
    got = clean.clean_names(raw, order="k").orderBy("uniqid").collect()
    assert [x.uniqid for x in got] == list(range(1, len(got) + 1))
    rows = [(x.k, x.FirstName, x["MiddleInitial/Name"], x.LastName, x.RomanNumeral, x.Suffix) for x in got]
    assert rows[0] == (1, "JOHN", "A.", "SMITH", "", "JR.") and (2, "JANE", "", "Doe", "", "") in rows and (2, "RICHARD", "", "Roe", "III", "") in rows
    assert [k for k, *_ in rows] == [1, 2, 2, 4, 7]
    assert clean.clean_names(raw, order="k", keep_all=True).count() == 7
    with pytest.raises(ValueError):
        clean.clean_names(raw, "None")
    assert N.parse("Dr. Maria van der Berg, PhD") | {"nickname": ""} == {"first": "Maria", "middle": "", "last": "van der Berg", "title": "Dr.", "suffix": "PhD", "nickname": ""}


def test_lookups_keep_first_or_last(spark):
    p = augment.prefix_table(spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "seat string, prefixes string, o int"), "seat", order="o")
    n = augment.nickname_table(spark.createDataFrame([("Bob, Rob - Bobby, B", 1), ("rob - other", 2), ("none", 3)], "value string, o int"), order="o")
    d = spark.createDataFrame([(1, "a", "ROB"), (2, "b", "Al"), (3, None, None)], "i int, seat string, FirstName string")
    assert [tuple(x) for x in augment.augment_names(d, p, n).orderBy("i").collect()] == [(1, "a", "ROB", "y", "bobby;b"), (2, "b", "Al", "", ""), (3, None, None, "", "")]


def _lev(a, b):
    return search.distance(a, b, 99)


@pytest.mark.parametrize("edits", [[(3, 1)], [2, 4], [(0, 1), (6, 2)]])
def test_fuzzy_dedup_against_the_nested_loop(spark, edits):
    r = random.Random(str(edits))
    rows = [(i, str(r.randint(0, 9)), "".join(r.choice("abc") for _ in range(r.randint(1, 8)))) for i in range(50)]
    gone = set()
    for i, u, a in rows:
        if i in gone:
            continue
        k = T.edit_threshold(len(a), edits)
        for j, v, b in rows[i + 1 :]:
            if _lev(a, b) <= k:
                gone |= {i, j} if u != v else {j}
    struck, want = set(), set()
    for i, u, a in rows:  # a struck row strikes no more; one that strikes itself still strikes the rest
        if i in struck:
            continue
        k, keep = T.edit_threshold(len(a), edits), True
        for j, v, b in rows[i + 1 :]:
            if _lev(a, b) <= k:
                struck.add(j)
                keep &= u == v
        if keep:
            want.add(i)
    d = spark.createDataFrame(rows, "o long, uniqid string, search_name string")
    assert {x.o for x in patterns.dedup_fuzzy(d, "o", edits).collect()} == want
    names = d.selectExpr("o AS id", "search_name AS name")
    pairs = {(x.i, x.j) for x in patterns.near_pairs(names, names, edits).collect()}
    assert pairs == {(i, j) for (i, _, a), (j, _, b) in itertools.product(rows, rows) if _lev(a, b) <= T.edit_threshold(len(a), edits)}


def test_fuzzy_dedup_compares_names_not_rows(spark, monkeypatch):
    r, edits, seen = random.Random(7), [(3, 1), (5, 2)], []
    bag = ["".join(r.choice("abcd") for _ in range(r.randint(2, 7))) for _ in range(40)] + [None]
    names = [r.choice(bag[max(0, i // 20 - 3) : i // 14 + 1]) for i in range(600)]
    rows = [(i, r.choice("uv") if kind % 3 == 0 else None if kind % 3 == 1 else "w", a) for i, a in enumerate(names) for kind in [len(a or "") + ord((a or "b")[-1])]]
    struck, want = set(), set()
    for i, u, a in rows:
        if a is None:
            want.add(i)
        elif i not in struck:
            near = [(j, v) for j, v, b in rows[i + 1 :] if b is not None and _lev(a, b) <= T.edit_threshold(len(a), edits)]
            struck |= {j for j, _ in near}
            if all(v == u for _, v in near):
                want.add(i)
    real = patterns.near_pairs
    monkeypatch.setattr(patterns, "near_pairs", lambda a, b, e: seen.append(a.count()) or real(a, b, e))
    d = spark.createDataFrame(rows, "o long, uniqid string, search_name string")
    assert {x.o for x in patterns.dedup_fuzzy(d, "o", edits).collect()} == want and len(want) > 1
    assert seen == [len({a for *_, a in rows if a is not None})]


def test_expansion_and_drop_list(spark):
    d = spark.createDataFrame([(1, "Ann", "Lee", "Dr;Mr", "")], "uniqid int, FirstName string, LastName string, prefixes string, nick_names string")
    e = patterns.expand(d)
    assert [x.search_name for x in e.orderBy("pat_ord", "prod_ord").collect()] == ["ann lee", "Dr lee", "Mr lee"]
    assert patterns.drop_listed(e, spark.createDataFrame([(" DR Lee",)], "search_name string")).count() == 2
    with pytest.raises(ValueError):
        patterns.expand(d, ["Unknown LastName"])


def test_linking_context_and_vectors(spark):
    kb = spark.createDataFrame([("Ann Lee", ["A. Lee", "Annie"]), ("Bo Ek", None)], "canonical string, aliases array<string>")
    m = spark.createDataFrame([("Annie",), ("ann  LEE!",), ("nobody",), (None,)], "entity string")
    assert {x.entity: (x.linked, x.confidence) for x in linking.link(m, linking.link_index(kb)).collect()} == {"Annie": ("Ann Lee", 1.0), "ann  LEE!": ("Ann Lee", 0.9), "nobody": (None, 0.0), None: (None, 0.0)}
    docs = spark.createDataFrame([(1, "Senator Ann Lee said so. Ann Lee"), (2, None)], "doc_id int, text string")
    f = linking.in_context(docs, ["ann lee", "zed"], window=9)
    assert sorted((x.start, x.person) for x in f.collect()) == [(8, True), (25, True)]
    assert {x.name: x.match_count for x in linking.context_counts(f, ["ann lee", "zed"]).collect()} == {"ann lee": 2, "zed": 0}
    assert [x.entity for x in linking.entities(docs).orderBy("start").collect()] == ["Senator Ann Lee", "Ann Lee"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [])], "vec_id int, embedding array<float>")
    assert {(x.id, x.other): x.similarity for x in linking.similar(v, least=0.5).collect()} == {p: 0.707107 for p in ((1, 2), (2, 1), (2, 3), (3, 2))}


def test_nearest_vectors_hold_only_the_best(spark, monkeypatch):
    import numpy as np

    g = np.random.default_rng(3)
    v = g.normal(size=(700, 8)).astype(np.float32)
    v[100:200], v[300:400], v[650:] = v[:100], v[:100], v[7]  # ties, of which the least ids count
    v[50] = 0
    u = v.astype(np.float64)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 6)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    for rows, tile, many in ((64, 32, 50), (1024, 2048, 1 << 16)):
        for name, n in (("ROWS", rows), ("TILE", tile), ("MANY", many), ("VALUES", rows * 16)):
            monkeypatch.setattr(linking, name, n)
        near = linking._Nearest(np.arange(700), u, True, -1.0, 5)
        assert near.s.shape == (700, 5)
        best = lambda i, keep, k: sorted((-s[i, j], j) for j in keep if j != i)[:k]
        got = {(x.id, x["rank"]): (-x.similarity, x.other) for x in linking.similar(d, k=5).collect()}
        assert got == {(i, r + 1): p for i in range(700) for r, p in enumerate(best(i, range(700), 5))}
        two = linking.similar(d.where("vec_id % 10 = 0"), d.where("vec_id % 10 <> 0"), least=0.5, k=6).collect()
        assert sorted((x.id, x["rank"], -x.similarity, x.other) for x in two) == [(i, r + 1, *p) for i in range(0, 700, 10) for r, p in enumerate(best(i, [j for j in range(700) if j % 10 and s[i, j] >= 0.5], 6))]
        assert {(x.id, x.other) for x in linking.similar(d, least=0.9).collect()} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.9)) if i != j}


def test_parsers_and_rules(spark):
    d = spark.createDataFrame([("Ravi Kumar",), ("John Smith",), (None,)], "name string")
    p = {x.name: x for x in parsers.parse_frame(d, "name").collect()}
    assert p["Ravi Kumar"].parser_used == "model" and p["John Smith"].parsed_confidence == 1.0 and p[None].parsed_confidence == 0.0
    assert parsers.compare_parsers(d, "name").count() == 9
    good, bad = validate(spark.createDataFrame([(0, 2, "a"), (3, 3, " "), (None, 1, "b")], "start int, end int, text string"), MENTION)
    assert good.count() == 1 and sorted(len(x.errors) for x in bad.collect()) == [2, 2]  # a null breaks every rule that reads it


def test_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("1", 'a "q", b\nc', "0.5"), ("2", "", "1")], "uniqid string, text string, my_confidence string").coalesce(1)
    for kind in files.FORMATS[:3]:
        assert files.write_counted(d, f"{tmp_path}/t.{kind}") == 2
        assert sorted(map(tuple, files.read_table(spark, f"{tmp_path}/t.{kind}").select(d.columns).collect())) == sorted(map(tuple, d.collect()))
    files.write_table(d, f"{tmp_path}/g", "csv", compression="gzip", confidence=False)
    assert files.read_table(spark, f"{tmp_path}/g").columns == ["uniqid", "text"]
    assert files.split_corpus(spark.range(25).withColumn("text", F.lit("x")), f"{tmp_path}/s", 10) == 3
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"chunk=chunk_00%2Fpart", "chunk=chunk_01%2Fpart", "chunk=chunk_02%2Fpart"}
    assert files.export_text(d, f"{tmp_path}/x") and not files.export_text(d, f"{tmp_path}/x")


def test_parts_keep_the_order_and_are_read_in_one_scan(spark, tmp_path):
    from quillsift.plans import catalogue

    spark.range(0, 1000, 1, 7).selectExpr("id AS p_partkey", "concat('a ', id % 9) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    d = spark.read.parquet(f"{tmp_path}/part.parquet")
    for _ in range(2):  # the second time files are replaced
        names = files.split_rows(d.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), f"{tmp_path}/s", 300)
    assert names == [f"rows_part{k:03d}.csv" for k in (1, 2, 3, 4)] and names == sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.endswith(".csv"))
    for k, n in enumerate(names):
        assert [int(line.split(",")[0]) for line in (tmp_path / "s" / n).read_text().splitlines()[1:]] == list(range(300 * k, min(1000, 300 * k + 300)))
    got = catalogue.split_part_files(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1  # not a plan for every file
    assert sorted(map(tuple, got.collect())) == [(n, min(300, 1000 - 300 * k), 300 * k, min(999, 300 * k + 299)) for k, n in enumerate(names)]


def test_configuration_and_commands(spark, tmp_path):
    c = Config()
    c.search.clean = False
    c.save(f"{tmp_path}/c.yaml")
    assert Config.load(f"{tmp_path}/c.yaml") == c and Config.of({"search": {"max_results": 3, "other": 1}}).search.max_results == 3
    (tmp_path / "bad.yaml").write_text("a: [")
    assert Config.load(f"{tmp_path}/bad.yaml") == Config()
    (tmp_path / "n.csv").write_text('Name,seat\n"Lee, Ann",x\n"Ek, Bo",y\n')
    (tmp_path / "d.csv").write_text("uniqid,text\n7,we met Ann Lee\n8,nothing\n")
    cli.main(["--config", f"{tmp_path}/c.yaml", "pipeline", f"{tmp_path}/n.csv", "--corpus", f"{tmp_path}/d.csv", "-o", f"{tmp_path}/out"], spark)
    (row,) = files.read_table(spark, f"{tmp_path}/out").collect()
    assert row.uniqid == "7" and row["name1.match"] == "ann lee" and row["count"] == "1"


def test_stemmers_on_known_words():
    from quillsift.functions.stem import porter, porter2

    known = dict(x.split(":") for x in "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop tanned:tan falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit vietnamization:vietnam predication:predic hopefulness:hope goodness:good formalize:formal electrical:electr revival:reviv allowance:allow inference:infer adjustable:adjust replacement:replac adoption:adopt effective:effect probate:probat rate:rate controll:control roll:roll".split())
    assert {w: porter(w) for w in known} == known
    known = dict(x.split(":") for x in "consign:consign consigned:consign consisting:consist consistency:consist consolation:consol knackeries:knackeri knightly:knight knives:knive generously:generous skies:sky dying:die news:news exceed:exceed happily:happili gas:gas".split())
    assert {w: porter2(w) for w in known} == known


def test_stems_of_bounded_memory(spark):
    from quillsift.functions.stem import porter

    r = random.Random(5)
    texts = [" ".join(r.choice(["running", "cats", f"walked{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}"]) for _ in range(50)) for _ in range(40)]
    want = [" ".join(map(porter, t.split())) for t in texts]
    stems = T._Stems(porter, 20)
    for t, w in zip(texts, want):
        assert stems(t) == w and len(stems.known) <= 20 and len(stems.older) <= 20
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "i int, t string").coalesce(1)
    assert [x.s for x in d.select("i", T.stemmed(F.col("t")).alias("s")).orderBy("i").collect()] == [*want, None, ""]


def test_engines_of_ones_own():
    class First(search.BaseSearchEngine):
        def hits(self, text):
            return [(i, at, at + len(k[1]), 0) for i, k in enumerate(self.keywords) if (at := text.lower().find(k[1])) >= 0]

    e = search.create_engine([("u", " Ann "), ("v", "bo"), ("u", "")], [(2, 1)], First)
    assert [(x["uniqid"], x["start"]) for x in e.search("bo and ann")] == [("u", 7), ("v", 0)] and len(e.search("bo and ann", 1)) == 1
    assert e.threshold("ann") == 1 and e.threshold("bo") == 0 and e.search(None) == []
    with pytest.raises(TypeError):
        search.BaseSearchEngine([("u", "a")]).search("a")


def test_names_of_any_form(spark):
    one = parsers.parse_names("Dr. Ann B. Lee Jr.")
    assert (one["title"], one["first_name"], one["middle_name"], one["last_name"], one["suffix"]) == ("Dr.", "Ann", "B.", "Lee", "Jr.")
    seen = []
    model = lambda names: seen.append(len(names)) or [{"first": "x", "last": n[:3], "confidence": 0.5 if n.startswith("Low") else 0.95} for n in names]
    some = parsers.parse_names(["Ravi Kumar", "Ann Lee", "Low Kumar", "", None, "Asha Rao"], model=model, batch_size=2)
    assert [x["parser_used"] for x in some] == ["model", "rule", "rule", "rule", "rule", "model"] and seen == [2, 1] and some[4]["confidence"] == 0.0
    assert parsers.parse_names(spark.createDataFrame([("Ann Lee",)], "name string")).first().parsed_last_name == "Lee"


def test_texts_processed_and_linked(spark):
    docs = spark.createDataFrame([(1, "Then Ann Lee met Bo Ekk"), (2, None)], "doc_id int, text string")
    kb = spark.createDataFrame([("Ann Lee", None), ("Bo Ek", ["B. Ek"])], "canonical string, aliases array<string>")
    embed = lambda c: F.array(*[(F.length(c) - F.length(F.replace(F.lower(c), F.lit(x), F.lit("")))).cast("float") for x in "abeklno"])
    calls = []

    def finder(texts):
        calls.append(len(texts))
        return [[(t.index("Ann"), t.index("Ann") + 7, "PERSON"), (t.index("Bo"), len(t), "PERSON"), (0, 4, "DATE")] if t else [] for t in texts]

    got = {x.entity: x for x in linking.process_text(docs, finder=finder, kb=kb, link_entities=True, embed=embed, threshold=0.7).collect()}
    assert set(got) == {"Ann Lee", "Bo Ekk"} and (got["Ann Lee"].linked, got["Ann Lee"].method) == ("Ann Lee", "exact")
    assert (got["Bo Ekk"].linked, got["Bo Ekk"].method) == ("Bo Ek", "semantic") and 0.7 <= got["Bo Ekk"].confidence < 1
    assert linking.process_text(docs, extract=False).count() == 0 and linking.process_text(docs).count() == 2


def test_commands_for_parsed_names(spark, tmp_path, capsys):
    (tmp_path / "n.csv").write_text("Name\nAnn Lee\nRavi Kumar\n")
    cli.main(["process-names", f"{tmp_path}/n.csv", "-o", f"{tmp_path}/p.json", "--no-confidence"], spark)
    assert files.read_table(spark, f"{tmp_path}/p.json").count() == 2 and "parsed_confidence" not in files.read_table(spark, f"{tmp_path}/p.json").columns
    cli.main(["validate-names", f"{tmp_path}/n.csv", "--least", "0.9"], spark)
    assert "Ravi Kumar" in capsys.readouterr().out
    cli.main(["compare-parsers", f"{tmp_path}/n.csv", "-o", f"{tmp_path}/c.csv"], spark)
    assert files.read_table(spark, f"{tmp_path}/c.csv").count() == 6
    cli.main(["generate-config", "-o", f"{tmp_path}/g.yaml", "--parser", "rule", "--ml-threshold", "0.5"], spark)
    assert (Config.load(f"{tmp_path}/g.yaml").names.parser, Config.load(f"{tmp_path}/g.yaml").names.ml_threshold) == ("rule", 0.5)
    (tmp_path / "s.csv").write_text("uniqid,search_name\n1,ann lee\n")
    (tmp_path / "d.csv").write_text("uniqid,text\n7,we met Ann Lee\n")
    for _ in range(2):
        cli.main(["pipeline", f"{tmp_path}/s.csv", "--corpus", f"{tmp_path}/d.csv", "-o", f"{tmp_path}/out", "--skip-clean", "--skip-merge", "--skip-preprocess", "--append"], spark)
    assert [x["name1.match"] for x in files.read_table(spark, f"{tmp_path}/out").collect()] == ["ann lee"] * 2
    assert Config.function("os.path:basename")("a/b") == "b" and Config.function("") is None


def test_streams_report_their_progress(spark, tmp_path):
    spark.range(10).selectExpr("CAST(id AS STRING) AS uniqid", "'ann lee' AS text").write.parquet(f"{tmp_path}/in")
    stream, seen = streaming.read_stream(spark, f"{tmp_path}/in", "uniqid string, text string"), []
    q = streaming.search_stream(stream, spark.createDataFrame([("1", "ann lee")], "uniqid string, search_name string"), f"{tmp_path}/out", f"{tmp_path}/state", seen.append)
    q.awaitTermination()
    r = streaming.rate(q, 20)
    assert seen == [0] and r["rows"] == 10 and r["percent"] == 50 and r["seconds_left"] > 0 and spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_exports_and_small_file_functions(spark, tmp_path):
    import quillsift

    assert all(callable(getattr(quillsift, n)) for n in quillsift.__all__)
    spark.range(100).write.parquet(f"{tmp_path}/p")
    assert files.choose_mode(f"{tmp_path}/p") == "batch" and files.choose_mode(f"{tmp_path}/p", 1e-6) == "streaming"
    d = spark.createDataFrame([("Ünï the, cats!",)], "t string")
    assert d.select(T.clean_text_by(F.col("t"), stem=True)).first()[0] == "uni cat" and d.select(T.clean_text_by(F.col("t"), accents=False, stopwords=False)).first()[0] == "ünï the cats"
    with pytest.raises(ValueError):
        files.write_table(d, f"{tmp_path}/x.xlsx")
