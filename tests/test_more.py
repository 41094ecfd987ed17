"""Hand-derived cases of the smaller operators."""

import math
import struct

from pyspark.sql import functions as F

from delver.functions import text
from delver.operators import dedup, itemset, keyphrase, learn, lsh, recsys, taxonomy, topics, wiki
from delver.sources import formats


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_text_expressions(spark):
    r = spark.range(1).select(
        text.half_width(F.lit("ＡＢ１！　x")), text.contained_in(F.lit("bc"), F.array(F.lit("abcd"), F.lit("bc"))), text.contained_in(F.lit("bc"), F.array(F.lit("bc"))),
        text.ends_with_any(F.array(F.lit("a"), F.lit("the")), ["the", "of"]), text.ends_with_any(F.array().cast("array<string>"), ["the"]),
        text.join_terms(F.array(F.lit("data"), F.lit("mining"), F.lit("数据"), F.lit("挖掘"), F.lit("x"))), text.bigrams(F.lit("数据挖 data ab1 掘")),
    ).first()
    assert list(r) == ["AB1! x", True, False, True, False, "data mining数据挖掘x", ["数据", "据挖", "data", "ab1", "掘"]]


def test_group_table(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (6, 5), (10, 11), (1, 11)], "a long, b long")
    none = spark.createDataFrame([], "doc_id long, group_id long")
    g = dedup.regroup(none, pairs)
    assert rows(g) == {(1, 1), (2, 1), (10, 1), (11, 1), (3, 3), (4, 3), (5, 5), (6, 5)}
    g = dedup.regroup(g, spark.createDataFrame([(23, 1), (24, 4), (23, 24)], "a long, b long"))
    same = {(r.a, r.b): r.same for r in dedup.same_group(g, spark.createDataFrame([(11, 23), (3, 24), (23, 24), (11, 4), (5, 1), (5, 99)], "a long, b long")).collect()}
    assert [same[k] for k in ((11, 23), (3, 24), (23, 24), (11, 4), (5, 1), (5, 99))] == [True] * 4 + [False] * 2
    left = dedup.without_docs(g, spark.createDataFrame([(1,), (5,)], "doc_id long"))
    assert rows(left) == {(d, 2) for d in (2, 3, 4, 10, 11, 23, 24)}


def test_trash_rule(spark):
    t = spark.createDataFrame([(b, 1, 1, i) for b in (0, 1) for i in range(5)] + [(1, 2, 2, 9)], "band int, mh long, ml long, class_id long")
    assert rows(dedup.without_trash(t, 5)) == {(0, 1, 1, i) for i in range(5)} | {(1, 2, 2, 9)}


def test_ordered_sets(spark):
    tx = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 1), (3, 9), (4, 10)], "tx_id long, item long")
    assert [r.tx_id for r in itemset.ordered_sets(tx).orderBy("rank").collect()] == [2, 3, 1, 4]
    assert [r.tx_id for r in itemset.ordered_sets(tx, True).orderBy("rank").collect()] == [2, 4, 3, 1]


def test_phrases(spark):
    g = spark.createDataFrame([("x", "12", "three"), ("x", "a", "五")], "ngram string, left string, right string")
    assert rows(keyphrase.group_numbers(g)) == {("x", "#", "#"), ("x", "a", "#")}
    uni, two = keyphrase.boundary_statistics(spark.createDataFrame([("we like %new york city% a lot",), ("%york%",)], "line string"))
    u = {r.term: tuple(r)[1:] for r in uni.collect()}
    assert u["like"] == (1, 1, 0, 0, 0, 0, 1) and u["new"] == (1, 0, 1, 0, 0, 0, 0) and u["york"] == (2, 0, 1, 1, 1, 0, 0) and u["a"] == (1, 0, 0, 0, 0, 1, 1)
    assert ("new", "york", 1, 1) in rows(two) and ("like", "new", 1, 0) in rows(two)
    r = spark.createDataFrame([(1, "new york", 1), (1, "new york city", 3), (1, "other", 2)], "doc_id long, ngram string, rank int")
    assert rows(keyphrase.merge_variants(r)) == {(1, "new york city", 1), (1, "other", 2)}
    phrases = spark.createDataFrame([(1, "big cat", 1), (1, "dog", 2), (2, "big cat", 1)], "doc_id long, ngram string, rank int")
    titles = spark.createDataFrame([(1, "cat", 1), (1, "dog", 1), (2, "cat", 2)], "doc_id long, term string, tf long")
    got = {(r.doc_id, r.ngram): r.score for r in keyphrase.translation_rank(phrases, titles, 4, 20).collect()}
    p = {(r.src, r.tgt): r.p for r in keyphrase.ibm_model1(spark.createDataFrame([(1, "big cat", "cat"), (1, "big cat", "dog"), (1, "dog", "cat"), (1, "dog", "dog"), (2, "big cat", "cat")], "pair_id long, src string, tgt string"), 20).collect()}
    assert abs(got[2, "big cat"] - 2 * math.log(2) * p["big cat", "cat"] * 4) < 1e-9
    assert abs(got[1, "dog"] - (math.log(2) * p["dog", "cat"] + math.log(4) * p["dog", "dog"])) < 1e-9


def test_topics(spark):
    docs = spark.createDataFrame([(i, f"solar eclipse seen over town {chr(97 + i % 7)}x", f"2024-01-{1 + i % 9:02d}") for i in range(30)], "doc_id long, text string, day string").withColumn("day", F.to_date("day"))
    t = topics.temporal_phrases(docs, "2024-01-06", "2024-01-08", exceptions=spark.createDataFrame([("eclipse seen",)], "ngram string"))
    names = {r.topic for r in t.collect()}
    assert "eclipse seen" not in names and t.agg(F.min("day")).first()[0] is None or str(t.agg(F.min("day")).first()[0]) >= "2024-01-03"
    s = spark.createDataFrame([(n, d, f) for n, f in (("a b", 3), ("a", 5), ("z", 1)) for d in ("2024-01-01", "2024-01-02")], "topic string, day string, freq long")
    got = topics.merge_topics(s, spark.createDataFrame([("a b", "a")], "a string, b string"))
    assert {(r.topic, tuple(r.names), r.freq) for r in got.collect()} == {("a", ("a b",), 5), ("z", ("z",), 1)}
    assert {str(r.day) for r in topics.trailing(docs, "2024-01-09", 2).collect()} == {"2024-01-08", "2024-01-09"}


def test_hash_composites(spark):
    r = spark.range(1).select(lsh.tail(F.lit(-3), 7), lsh.lowest_bit(F.lit(5)), *lsh.delta_lowest_bit(F.lit(4), F.lit(0.9)), *lsh.delta_xor([(F.lit(1), F.lit(0.5)), (F.lit(1), F.lit(0.2))]), lsh.asymmetric_distance(F.lit(5), F.array(F.lit(0.5), F.lit(9.0), F.lit(0.25)), F.lit(0))).first()
    assert list(r) == [4, 1, 0, 1 - 0.9, 0, 0.2, 0.75]
    assert lsh.tune(1, 100, lambda x: x * x >= 50) == 8 and lsh.tune(1, 5, lambda x: False) == 5
    t = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "c")], "tab int, flip string")
    assert rows(lsh.posteriori(t, 1)) == {(0, "a", 2 / 3, 1), (1, "c", 1.0, 1)}


def test_learners(spark):
    ev = spark.createDataFrame([(["rain", "cold"], "in", 9), (["sun"], "out", 7), (["sun", "cold"], "out", 2), (["rain"], "in", 3), (["cold"], "in", 2)], "context array<string>, outcome string, n long")
    q = spark.createDataFrame([(1, ["rain"]), (2, ["sun"])], "id long, context array<string>")
    theta = learn.lbfgs(ev)
    assert {r.id: r.outcome for r in learn.best_outcome(learn.maxent_predict(q, theta)).collect()} == {1: "in", 2: "out"}
    titles = spark.createDataFrame([(1, "Books > Weather", "rain", 5.0), (2, "x/y", "sun", 5.0), (3, "x", "sun", 500.0)], "id long, path string, title string, price double")
    direct = spark.createDataFrame([("books>weather", "book")], "path string, category string")
    ranges = spark.createDataFrame([("out", 0.0, 100.0)], "category string, low double, high double")
    assert rows(learn.categorize(titles, theta, direct, ranges)) == {(1, "book"), (2, "out")}
    data = spark.createDataFrame([([f"u{u}", f"i{i}"], float(u + 2 * i)) for u in range(4) for i in range(4) for _ in range(5)], "cols array<string>, y double")
    w0, w, v = learn.factorize(data, factors=2, rounds=100, rate=0.2)
    x = data.withColumn("row_id", F.monotonically_increasing_id()).cache()
    p = learn.fm_predict(x.select("row_id", F.explode("cols").alias("col"), F.lit(1.0).alias("val")), w0, w, v).join(x.select("row_id", "y"), "row_id")
    assert learn.rmse(p).first().rmse < 1.0
    lp = learn.log_posterior(spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "z", 2)], "topic string, term string, n long"))
    assert abs({(r.topic, r.term): r.logp for r in lp.collect()}["a", "x"] - math.log(3.1 / 4.3)) < 1e-12


def test_spellings_and_fuzzy_rules(spark):
    got = {(r.variant, r.weight) for r in taxonomy.fuzzy(spark.createDataFrame([("zan",)], "syllable string")).collect()}
    assert got == {("zan", 1.0), ("zang", 0.5), ("zhan", 0.5)}
    assert {r.variant for r in taxonomy.fuzzy(spark.createDataFrame([("shagn",)], "syllable string")).collect()} == {"shang", "shan", "sang"}
    t = spark.createDataFrame([("重", "zhong"), ("重", "chong"), ("庆", "qing")], "char string, spelling string")
    assert rows(taxonomy.spellings(spark.createDataFrame([(1, "重庆a")], "id long, text string"), t)) == {(1, "zhongqinga", "zqa"), (1, "chongqinga", "cqa")}


def test_wiki_markup(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>Paris</title><text>The city of [[France|French]] light. [[Category:Cities|P]] near [[Seine]] river</text></page>\n<page><title>Talk:X</title><text>[[Category:No]]</text></page><page><title>Par</title><text>#REDIRECT [[Paris]]</text></page></mediawiki>")
    d = formats.read_dump(spark, str(tmp_path / "d.xml"))
    assert rows(wiki.markup_categories(d)) == {("Paris", "Cities")}
    assert {tuple(r)[2:] for r in wiki.markup_links(d).collect() if r.title == "Paris"} == {("France", "French", "of", "light"), ("Seine", "Seine", "near", "river")}
    assert not [r for r in wiki.markup_links(d).collect() if r.title == "Par"]
    types = spark.createDataFrame([("Paris", "place"), ("Paris", "person")], "entity string, type string")
    red = spark.createDataFrame([("Par", "Paris")], "title string, target string")
    assert rows(wiki.propagate_types(types, red, ["person", "place"])) == {("Paris", "person"), ("Par", "person")}
    f = spark.createDataFrame([("a", "f1", 1.0), ("b", "f2", 0.5)], "surface string, feature string, value double")
    assert rows(wiki.libsvm_of_class(f, spark.createDataFrame([("a", "x")], "surface string, type string"), "x")) == {("a", 1, "1:1.0000"), ("b", -1, "2:0.5000")}


def test_files(spark, tmp_path):
    m = spark.createDataFrame([("p", "o", 0.5)], "pred string, outcome string, theta double")
    for kind in ("parquet", "json", "text"):
        formats.save_model(m, str(tmp_path / kind), kind)
        assert rows(formats.load_model(spark, str(tmp_path / kind), "pred string, outcome string, theta double", kind)) == {("p", "o", 0.5)}
    ev = spark.createDataFrame([(4, "yes", ["a", "b"], [1.0, 0.5]), (1, "no", [], [])], "n long, outcome string, context array<string>, values array<double>")
    formats.write_events(ev, str(tmp_path / "ev"))
    assert {(r.n, r.outcome, tuple(r.context), tuple(r["values"])) for r in formats.read_event_values(spark, str(tmp_path / "ev")).collect()} == {(4, "yes", ("a", "b"), (1.0, 0.5)), (1, "no", (), ())}
    (tmp_path / "s.txt").write_text("The\n# note\nof # x\n\nthe\n")
    assert rows(formats.read_stopwords(spark, str(tmp_path / "s.txt"))) == {("the",), ("of",)}
    (tmp_path / "m.bin").write_bytes(struct.pack("<3I4f", 4, 2, 2, 1, 2, 3, 4))
    assert {(r.id, tuple(r.v)) for r in formats.read_matrix(spark, str(tmp_path / "m.bin")).collect()} == {(0, (1.0, 2.0)), (1, (3.0, 4.0))}
    (tmp_path / "k.txt").write_text("7 2 5 0.5 9 1.5\n")
    assert rows(formats.read_neighbours(spark, str(tmp_path / "k.txt"))) == {(7, 1, 5, 0.5), (7, 2, 9, 1.5)}
    formats.write_topics(spark.createDataFrame([("t", "2024-01-01", [1, 0])], "topic string, start string, series array<int>"), str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t/dat")).collect()} == {"t 0 1", "t 1 0"} and '"series":[1,0]' in spark.read.text(str(tmp_path / "t/json")).first().value
    formats.write_split(spark.range(10).coalesce(1), str(tmp_path / "split"), 4)
    assert len(list((tmp_path / "split").glob("*.parquet"))) == 3


def test_functions_in_sql(spark):
    recsys.register_functions(spark)
    assert spark.sql("SELECT delver_tokens('Él, x-2')").first()[0] == ["él", "x", "2"]
    assert rows(spark.sql("SELECT * FROM delver_segments('One. Two! ')")) == {(0, "One"), (1, "Two")}
    m = spark.createDataFrame([(1, 2, 3), (1, 3, 4)], "i long, j long, n long")
    assert rows(recsys.update_rows(m, lambda p: p.assign(n=p.n * 2), "i long, j long, n long")) == {(1, 2, 6), (1, 3, 8)}
