"""The training-data operators against brute force, round trips, held-out rows and odd inputs."""

import collections
import hashlib
import inspect
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from delver.llm import chat, decontaminate, hnsw, htmltext, langid, linededup, lmscore, minhash, mixing, secrets
from delver.llm.common import components, gram_hashes, mix, word_table

CLASH = "_key,_bad,_d,_s,_tie,_tag,_n,_block,tag,row,h,host,n,word,context,n_lines,n_removed,N_HIT,lang_pred,score,epoch,block_rank,doc_rank,weight,epochs,block,class_id,label,dim,unit,salt".split(",")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string" + "".join(f", {c} string" for c in CLASH)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", *CLASH) for i, t, lang, src in rows], DOCS)


def words(t):
    return WORD.findall((t or "").translate(LOWER))


ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "  \n ", None, "b"), (None, "Some words here", None, None), (5, "7 8 9 !!", "en", "a"), (6, "\0é漢字\0 x" * 3, "fr", "b"), (7, "Some words here", "en", "a"), (7, "Some words here", "en", "a")]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_and_empty_tables(spark, rows):
    d = docs(spark, rows)
    bench = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (3, "some WORDS")], "item_id long, text string")
    n = len(rows)
    assert decontaminate.decontaminate(d, bench).count() == n
    assert linededup.line_dedup(d).count() == n
    assert minhash.near_duplicates(d).count() == n
    model = langid.train(d)
    found = langid.identify(d, model).collect()
    assert len(found) == n and all(r.lang_pred == "und" for r in found if not re.search(r"[^\W\d_]", r.text or ""))
    assert all(0 <= r.score <= 1 for r in found)
    assert secrets.scan(d).count() == n
    scored = lmscore.prepared(d)
    assert lmscore.score(scored, *lmscore.train(scored)).count() == n
    mixed = mixing.mix(d)
    assert mixed.count() == n
    assert mixing.materialise(d, mixed).count() >= n
    pages = d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASH)
    assert sum(r.text == "" for r in htmltext.extract(pages).collect()) == sum(not (t or "").strip() for _, t, _, _ in rows)
    chats = d.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", *CLASH)
    assert chat.digests(chat.format_conversations(chats)).count() == len({r[0] for r in rows})
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.array(F.col("n_chars").cast("double"), F.lit(1.0)).alias("embedding"), *CLASH)
    assert hnsw.near_vectors(vectors).count() == n


@pytest.mark.parametrize("rows", [[], ODD])
def test_stages_take_odd_and_empty_tables(spark, sf, rows):
    """Every stage keeps the columns, clashing names with their values included, and the documents it has no case against."""
    d = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        got = out.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            replaced = {"weight", "epoch", "block_rank", "doc_rank"}
            assert set(out.columns) == set(d.columns) and len(got) >= len(rows)
        else:
            replaced = set()
            assert out.columns == d.columns
        assert all(r[c] == c for r in got for c in CLASH if c not in replaced)
        ids = collections.Counter(r.doc_id for r in got)
        if rows and name == "line dedup":
            assert ids == collections.Counter(r[0] for r in rows)
        if rows and name == "MinHash near-dedup":
            assert ids == {1: 1, 2: 1, 3: 1, None: 1, 5: 1, 6: 1, 7: 1}
        if rows and name == "benchmark decontamination":
            assert ids == collections.Counter(r[0] for r in rows)


def test_very_long_texts(spark):
    long = " ".join(f"word{k % 9973} and" for k in range(200_000))  # 2 MB
    d = docs(spark, [(1, long, "en", "a"), (2, long + " tail", "en", "b"), (3, "short one here", "en", "a")])
    bench = spark.createDataFrame([(1, " ".join(f"word{k} and" for k in range(5000, 5010)))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, bench).collect()}
    assert got[1].n_words == 400_000 and got[1].n_hit == 20 * 20 and got[3].n_hit == 0
    assert {r.doc_id: r.kept for r in minhash.near_duplicates(d).collect()} == {1: True, 2: False, 3: True}
    assert linededup.line_dedup(d).where("length(text) > 1000000").count() == 2
    assert secrets.scan(docs(spark, [(1, "x " * 500_000 + "token = " + "A1b2" * 10, "en", "a")])).first().spans.startswith("assign:1000000:1000048")
    scored = lmscore.prepared(d)
    assert {r.doc_id: r.n_tokens for r in lmscore.score(scored, *lmscore.train(scored)).collect()} == {1: 400_000, 2: 400_001, 3: 3}
    assert langid.identify(d, langid.train(d)).where("lang_pred = 'en'").count() == 3
    page = spark.createDataFrame([(1, "http://a/", f"<article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert htmltext.extract(page).first().n_chars == len(long)


def test_two_texts_under_one_id_keep_their_links(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " q"), (3, b + " q"), (4, "something else altogether")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_id, r.kept) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    v = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    out = hnsw.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component_id, r.n_links) for r in out) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_missing_shard_and_missed_audit_are_errors(spark, monkeypatch, tmp_path):
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 5)]) for k in range(40)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(hnsw.Graph, "audit", lambda self, *_: 0.5)
    build = hnsw._build

    def low(dim, sample, threshold, recall):
        real = build(dim, sample, threshold, recall)
        return lambda t: real(t).set_column(2, "recall", pa.array([0.5]))

    monkeypatch.setattr(hnsw, "_build", low)
    with pytest.raises(ValueError, match="miss a recall"):
        hnsw.near_vectors(v).collect()
    run = hnsw._query(f"file://{tmp_path}/none", [0], 3, 0.95, 100)
    with pytest.raises(FileNotFoundError):
        list(run([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([np.ones(3).tobytes()])], ["id", "unit"])]))


def test_decontamination_is_exact_in_one_and_many_blocks(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, words(r.text)) for r in b.collect()]
    extra = [(9001, " ".join(items[0][1][3:13]).upper()), (9002, " ".join(items[0][1][3:12])), (9003, "zz tiny item zz"), (9004, None)]
    d = d.union(spark.createDataFrame(extra, d.schema))
    b = b.union(spark.createDataFrame([(777, "Tiny item"), (778, ""), (779, None)], b.schema))
    items += [(777, ["tiny", "item"])]
    want = {}
    windows = collections.defaultdict(set)
    for i, w in items:
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(k) for k in windows}
    for r in d.collect():
        w, hit, own = words(r.text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    own |= x
        want[r.doc_id] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    for size in (16_000_000, 3000):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(d, b, block_bytes=size).collect()}
        assert got == want


def test_winnowing_keeps_a_print_of_every_shared_span():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 62, 200).astype(np.uint64) for _ in range(2))
    b[50:60] = a[120:130]
    ga, gb = gram_hashes(a, 5), gram_hashes(b, 5)
    pa, pb = (set(g[decontaminate.winnow(g, np.ones(len(g), bool))].tolist()) for g in (ga, gb))
    assert pa & pb


def test_line_dedup_exact_at_the_threshold_and_joined_path(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"  nine \nown line {k}\nten\n\nthe end" if k < 9 else f"own line {k}\nten\t\r\nx", "en", f"s{k}"))
    rows += [(100 + k, "copied everywhere\nkept", "en", "s1") for k in range(30)]  # one site only
    rows.append((500, "ten", "en", None))
    d = docs(spark, rows)
    lines = collections.defaultdict(set)
    for _, t, _, s in rows:
        for x in t.split("\n"):
            if s is not None and x.strip(" \t\r"):
                lines[x.strip(" \t\r")].add(s)
    bad = {x for x, s in lines.items() if len(s) >= 10}
    assert bad == {"ten"}
    want = {i: "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad) for i, t, _, _ in rows}
    for limit in (4_000_000, 0):
        out = linededup.line_dedup(d, 10, broadcast_lines=limit)
        assert {r.doc_id: r.text for r in out.collect()} == want
        assert set(d.columns) <= set(out.columns)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    err = []
    for trial in range(40):
        n = int(rng.integers(1, 300))
        a = rng.random(n) * 3
        b = a * (rng.random(n) < 0.8) + rng.random(n) * (rng.random(n) < 0.2)
        a[0] = b[0] = 1
        e = np.tile(mix((np.arange(n) + 1000 * trial).astype(np.uint64)), 2)
        w, d = np.concatenate((a, b)), np.repeat([0, 1], n)
        s = minhash.signatures(d[w > 0], e[w > 0], w[w > 0], 2)
        err.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.06


def test_near_duplicates_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    rows += [(5000 + k, " ".join([*base, f"tail{k}"])) for k in range(40)]  # a hot group of different texts
    rows += [(6000, "!!!"), (6001, "!!!"), (6002, None), (6003, ""), (6004, "  "), (6005, "single"), (6006, "SINGLE")]
    bags = {}
    for i, t in rows:
        _, _, _, _, w = word_table([(t or "").encode()])
        bags[i] = collections.Counter((gram_hashes(w, 2) if len(w) > 1 else w).tolist())
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8192, 16):
        out = {r.doc_id: r for r in minhash.near_duplicates(d, block=block).collect()}
        assert len(out) == len(rows)
        for i, a in bags.items():
            for j, b in bags.items():
                if i < j and a and b:
                    jac = sum((a & b).values()) / sum((a | b).values())
                    if jac >= 0.75:
                        assert out[i].group_id == out[j].group_id, (i, j, jac)
        assert out[6000].group_id == out[6001].group_id == 6000 and out[6005].group_id == out[6006].group_id
        assert all(out[i].kept for i in (6002, 6003, 6004))
        assert {out[5000 + k].group_id for k in range(40)} == {5000}
        groups = collections.defaultdict(list)
        for i, r in out.items():
            groups[r.group_id].append(i)
        for g, m in groups.items():
            assert g == min(m) and sum(out[i].kept for i in m) == 1


def edited_pairs(n, seed=0):
    """n pairs of texts of their own words; the second one has some words replaced, so that Jaccard lies around 0.45 to 0.75."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{k}x{i}" for i in range(120)]
        other = list(words)
        for i in rng.choice(120, int(rng.integers(10, 26)), False):
            other[i] += "y"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return rows


def text_signatures(rows):
    _, _, _, doc, words = word_table([t.encode() for _, t in rows])
    return minhash.signatures(*minhash.elements(words, doc, len(rows)), len(rows))


def test_every_pair_at_the_stated_threshold_is_linked(spark):
    rows = edited_pairs(400)
    sig = text_signatures(rows)
    alike = (sig[::2] == sig[1::2]).mean(1)
    out = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = np.array([out[2 * k].group_id == out[2 * k + 1].group_id for k in range(400)])
    assert ((alike >= 0.55) & (alike < 0.65)).sum() > 50 and (linked == (alike >= 0.55)).all()


def test_link_counts_are_exact(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    rows = [(5000 + k, " ".join([*base, f"tail{k}"])) for k in range(40)] + edited_pairs(60)
    alike = np.array([(x == s).mean(1) for s in [text_signatures(rows)] for x in s]) >= 0.55
    want = {r[0]: int(alike[i].sum()) - 1 for i, r in enumerate(rows)}
    for block in (8192, 8):
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
        assert {r.doc_id: r.n_links for r in out.collect()} == want
    assert want[5000] == 39


def test_components_in_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for limit in (2_000_000, 0):
        assert {r.node: r.component for r in components(spark, df, limit).collect()} == want


def test_hnsw_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 24))
    for k in range(8):  # near copies in groups of several sizes
        x[100 + 40 * k : 100 + 40 * k + 5 * k + 2] = x[k] + rng.normal(size=(5 * k + 2, 24)) * 0.04
    x[500:540] = x[9] * 2  # copies after scaling
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [None] + [1.0] * 23, 1), (903, [float("inf")] * 24, 1), (904, [], 1), (905, [1.0, 0.0], 1), (906, [2.0, 0.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in hnsw.near_vectors(d, shard_rows=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    comp = np.arange(600)
    for _ in range(600):
        new = np.array([min(comp[i], comp[s[i]].min(initial=10**9)) for i in range(600)])
        if (new == comp).all():
            break
        comp = new
    got = np.array([out[i].n_links for i in range(600)])
    assert (got <= s.sum(1)).all() and got.sum() >= 0.98 * s.sum()
    assert np.mean([out[i].component_id == comp[i] for i in range(600)]) > 0.98
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(900, 905))
    assert out[906].component_id == 905 and out[905].n_links == 1
    assert hnsw.near_vectors(d.limit(0)).count() == 0


def test_html_cases(spark):
    boiler = "<div><p>Follow our daily letter about everything</p></div>"
    rows = [(k, f"http://a.example.com/{k}", f"<html><body>{boiler}<div><h1>Title {k}</h1><p>Body &amp; text   {k}<p>more {k}<br>here</div><footer>f</footer></body>") for k in range(12)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://b/", "<article>x<nav>menu</nav><div class='reader-comments'>c</div><p>y&lt;</article>tail"), (103, "http://b/", "<ul><li>a<li>b</ul><script>1<2</script><!-- c"), (104, None, "plain < text &am")]
    out = {}
    for limit in (500_000, 0):
        got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=limit).collect()}
        assert not out or {k: r.text for k, r in got.items()} == {k: r.text for k, r in out.items()}
        out = got
    assert out[3].text == "Title 3\nBody & text 3\nmore 3 here" and out[3].n_chars == len(out[3].text)
    assert [out[k].text for k in range(100, 105)] == ["", "", "x\ny<", "a\nb", "plain < text &am"]


def test_chat_round_trip(spark):
    odd = ["", " lead", "<|end|>", "<\\|turn|>", "a\n\n<|endoftext|>é漢🙂\n", "</s>[INST] ok [/INST]", "<|" * 5 + "\\"]
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", odd[(c * 3 + t) % len(odd)]) for c in range(6) for t in range(5)] + [(50, 0, None, None), (51, None, "assistant", "x"), (None, 0, "system<|say|>", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(d)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def keys(n, length=40, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), length)) for _ in range(n)]


def test_secret_base_spans(spark):
    rows = [(1000, "token: short AKIA123 " + "a" * 31), (1001, None), (1002, "AKIA" + "Z9" * 6 + "\npassword=hunter2hunter2 " + "0f" * 16 + "z"), (1004, "ſecret: abcdefgh12"), (1005, "x TOKEN = \"abcdefgh\" y")]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    plain = lambda r: ",".join(x for x in r.spans.split(",") if not x.startswith("model"))
    assert plain(out[1000]) == "" and out[1001].spans == "" and out[1004].n_assign == 0
    assert plain(out[1002]) == "access:0:16,assign:17:40,hex:41:73" and (out[1005].n_assign, plain(out[1005])) == (1, "assign:2:19")
    assert all(r.base_sha256 == hashlib.sha256(plain(r).encode()).hexdigest() for r in out.values())


def test_secret_base_counts_equal_sql(spark, sf):
    import duckdb

    out = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    sql = f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)),
      len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)), len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32))
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM read_parquet('{sf}/documents.parquet'))"""
    assert out == {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}


def test_planted_keys_are_found_at_every_size(spark, sf):
    """Keys that no pattern knows, in documents of the tables: nine tenths are added, and next to nothing else."""
    for folder in (sf, "/root/testdata/sf0.01"):
        d = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").select("doc_id", "text").orderBy("doc_id").collect()
        new, rows = keys(60), []
        for k, r in enumerate(d):
            if k < 60:
                words = r.text.split(" ")
                words.insert(len(words) // 2, new[k])
                rows.append((r.doc_id, " ".join(words)))
            else:
                rows.append((r.doc_id, r.text))
        out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        found = 0
        for (i, text), key in zip(rows[:60], new, strict=True):
            at = text.index(key)
            found += f"model:{at}:{at + 40}" in out[i].spans
        assert found >= 54
        labelled = sum(r.n_assign + r.n_access + r.n_hex > 0 for r in out.values())
        assert sum(r.n_model > 0 for r in out.values()) <= found + labelled + 0.02 * len(rows)


def test_scan_adds_keys_that_its_sample_holds_as_unlabelled(spark):
    known = [f"word TOKEN = \"{k}\" and user{i}.12345@mail.example.com or 2024-05-0{i % 9 + 1}-0000 text" for i, k in enumerate(keys(300))]
    new = [f"bearer {k} end" for k in keys(20, seed=2)]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(known + new)), "doc_id long, text string")).collect()}
    assert sum(out[i].spans == "model:7:47" for i in range(300, 320)) >= 18
    assert sum(out[i].n_model >= 1 for i in range(300)) >= 290 and sum(out[i].n_model for i in range(300)) < 330


def test_every_candidate_is_trained_on(spark, monkeypatch):
    """More distinct candidates of either label than any sample of 1,000, and one of 5,000 characters."""
    some = keys(3000, length=24)
    texts = [f"word TOKEN = \"{k}\" text" for k in some[:1500]] + [f"see mail{i}.{k[:4].lower()}.example.com there" for i, k in enumerate(some[1500:])] + ["token=" + "".join(keys(1, length=5000, seed=7))]
    seen, real = [], secrets.learn
    monkeypatch.setattr(secrets, "learn", lambda sample, *recall: seen.extend(sample) or real([], *recall))
    assert secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
    want = {(x, y) for t in texts for _, _, x, y in secrets.candidates(t)[1]}
    assert len(seen) == len(want) and set(seen) == want and sum(y for _, y in seen) == 1501


def test_shards_learn_what_one_driver_does(spark):
    known = [f"word TOKEN = \"{k}\" and user{i}.12345@mail.example.com or 2024-05-0{i % 9 + 1}-0000 text" for i, k in enumerate(keys(300))]
    new = [f"bearer {k} end" for k in keys(20, seed=2)]
    rows = list(enumerate(known + new))
    out = []
    for parts in (1, 5):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out.append({r.doc_id: r for r in secrets.scan(d, shard=300).collect()})
    assert sum(out[0][i].spans == "model:7:47" for i in range(300, 320)) >= 18
    assert sum(out[0][i].n_model >= 1 for i in range(300)) >= 290 and sum(out[0][i].n_model for i in range(300)) < 330
    assert out[0] == out[1]


def test_network_and_candidates_against_plain_loops():
    texts = ["a token=Abc123xyz789QQ, plainword aLongerWordHere x_y_zzzz_w 12345678 \"letmeinplease\" " + "Zz9" * 60, "é" + "f" * 40 + " ab", "AKIA" + "Q" * 14 + " password: secretsecret", ""]
    chars = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    net = secrets.learn([])
    for text in texts:
        runs, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in chars:
                j += 1
            run = text[i:j]
            letters = re.sub(r"[^A-Za-z]", " ", run)
            told = any(c.isdigit() for c in run) or len(re.findall(r"[a-z][A-Z]", letters)) >= 2 or bool(re.search(r"[A-Za-z][+/_][A-Za-z]", run))
            before = re.search(r"[:=][\"' ]?$|[\"']$|\bbearer $", text[max(0, i - 8) : i], re.I)
            if j - i >= 8 and (told or before or j - i >= 20 and any(c.isalnum() for c in run)):
                runs.append((i, j))
            i = j + 1 if j == i else j
        base, found = secrets.candidates(text)
        assert {(s, e) for s, e, _, _ in found} >= set(runs)
        for s, e, snippet, label in found:
            assert label == int(any(b[0] < e and s < b[2] for b in base))
            left, own, right = snippet.split("\0")
            code = [c - 30 if 32 <= c < 127 else 1 for c in (left + own + right).encode("latin-1", "replace")]
            flag = [0.0] * len(left) + [1.0] * len(own) + [0.0] * len(right)
            top, total, n = np.zeros(secrets.FILTERS), np.zeros(secrets.FILTERS), 0.0
            step = secrets.PIECE - secrets.WIDTH + 1
            for a in range(0, max(1, len(code) - secrets.WIDTH + 1), step):
                x, f = (code[a : a + secrets.PIECE] + [0] * secrets.PIECE)[: secrets.PIECE], (flag[a : a + secrets.PIECE] + [0.0] * secrets.PIECE)[: secrets.PIECE]
                for t in range(step):
                    win = np.concatenate([np.append(net.e[x[t + k]], f[t + k]) for k in range(secrets.WIDTH)])
                    h = np.maximum(win @ net.w + net.b, 0)
                    top = np.maximum(top, h)
                    if f[t + secrets.WIDTH // 2]:
                        total, n = total + h, n + 1
            want = np.concatenate((top, total / max(n, 1), [np.log2(1 + len(own)) / 4])) @ net.v + net.c[0]
            assert abs(net.logits([snippet])[0] - want) < 1e-3 * max(1, abs(want))


def test_language_tables_are_the_kernel(spark, sf):
    """Folded tables against explicit kernels over Python sets and a dense one-versus-rest solution."""
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and text is not null").limit(60).collect()]
    model = langid.fit(rows, landmarks=24)
    scratch = [np.zeros(c, np.int32) for c in langid.CELLS]
    sets = [[set(g.tolist()) for g in langid.grams(t, scratch)] for t, _ in rows]
    kernel = lambda a, b: np.mean([len(x & y) / np.sqrt(len(x) * len(y)) if x and y else 0 for x, y in zip(a, b, strict=True)])
    langs = sorted({lang for _, lang in rows})
    marks = sorted(i for lang in langs for i in [k for k, (_, own) in enumerate(rows) if own == lang][: 24 // len(langs)])
    k = np.array([[kernel(a, sets[j]) for j in marks] for a in sets])
    values, vectors = np.linalg.eigh((k[marks] + k[marks].T) / 2)
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    z, y = k @ half, np.array([[1.0 if own == lang else -1.0 for lang in langs] for _, own in rows])
    w = np.sqrt(len(rows) / len(langs) / np.array([sum(own == x for _, x in rows) for _, own in rows]))[:, None]
    alpha = half @ np.linalg.solve((z * w).T @ (z * w) + 1e-2 * np.eye(z.shape[1]), (z * w).T @ (y * w))
    assert np.abs(model.margins([t for t, _ in rows]) - k @ alpha).max() < 1e-3


def test_many_languages_and_short_texts_all_train(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnop"), 4)) for _ in range(3)) + f" x{i % 250}y", f"l{i % 250:03d}", "a") for i in range(2500)]
    assert len(langid.train(docs(spark, rows)).langs) == 250


def test_language_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(d, langid.train(d)).where(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.9


def test_pseudo_likelihood_matches_a_plain_loop(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    table = {r.doc_id: r.text for r in d.collect()}
    rows = lmscore.prepared(d)
    v, theta = lmscore.train(rows)
    assert len(theta) == lmscore.SIZE
    got = {r.doc_id: r for r in lmscore.score(rows, v, theta).collect()}
    p = {k: x.astype(float) for k, x in lmscore.views(theta).items()}
    own, seen = {}, collections.defaultdict(collections.Counter)
    for i, text in table.items():
        _, word = lmscore.words([text.encode()])
        own[i] = word
        pairs = [(word[t - 1] if t else None, word[t + 1] if t + 1 < len(word) else None) for t in range(len(word))]
        chosen = set(lmscore.remembered(lmscore.contexts(np.zeros(len(word), int), word)).tolist())
        own[i] = (word, pairs, chosen)
        for t in chosen:
            seen[pairs[t]][word[t]] += 1
    for i in list(table)[:8]:
        word, pairs, chosen = own[i]
        cell = lmscore.cells(word)
        total = hits = 0
        for t in range(len(cell)):
            h = p["b"].copy()
            for k, o in enumerate(lmscore.OFFSETS):
                h += p["e"][v.context[cell[t + o]] if 0 <= t + o < len(cell) else 0] * p["d"][k]
            z = np.tanh(h) @ p["w"] + p["c"]
            x = z[v.of[cell[t]]] - np.log(np.exp(z).sum()) + v.log_within[cell[t]]
            if t in chosen and (n := sum(seen[pairs[t]].values()) - 1) > 0:
                m = seen[pairs[t]][word[t]] - 1
                x = np.log(np.exp(x) / (n + 1) + m / (n + 1))
                hits += m > 0
            total += x
        assert got[i].n_tokens == len(cell) and abs(got[i].pll - total) < 1e-3 * max(1, abs(total))
        assert got[i].recalled is None if not chosen else abs(got[i].recalled - hits / len(chosen)) < 1e-12


def test_word_order_is_worth_two_tenths_of_a_nat(spark):
    """At sf0.01, the network alone (the memory knows texts as they stand)."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lmscore.prepared(d)
    v, theta = lmscore.train(rows)
    doc, word = lmscore.words([r.text.encode() for r in d.collect() if r.text])
    order = np.lexsort((np.random.default_rng(0).random(len(doc)), doc))
    plain = lmscore.log_probabilities(theta, v, doc, lmscore.cells(word)).mean()
    assert plain > lmscore.log_probabilities(theta, v, doc, lmscore.cells(word[order])).mean() + 0.2


def test_scores_do_not_depend_on_the_files_and_repeats_stand_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d = d.union(d.where("doc_id % 10 = 0").selectExpr("doc_id + 100000", "text"))
    out = []
    for table in (d.coalesce(1), d.repartition(7, "doc_id").sortWithinPartitions("text")):
        rows = lmscore.prepared(table)
        out.append({r.doc_id: r for r in lmscore.score(rows, *lmscore.train(rows)).collect()})
    assert out[0].keys() == out[1].keys() and all(abs(r.pll - out[1][i].pll) < 1e-3 * max(1, abs(r.pll)) for i, r in out[0].items())
    assert all(abs(out[0][i].pll - out[0][i - 100000].pll) < 1e-6 * abs(out[0][i].pll) for i in out[0] if i >= 100000)
    twice = [r.recalled for i, r in out[0].items() if i >= 100000 and r.recalled is not None]
    assert np.mean(np.array(twice) == 1) == 1


def test_memory_counts_every_context(spark):
    """m and d at every position, over several parts, chunks and a hot context (single words), against plain counters."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9, rng.integers(1, 12))) for _ in range(300)] + [f"only{k % 400}" for k in range(700)] + [None, "", "?"]
    rows = lmscore.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    v = lmscore.Vocabulary(lmscore.counts(rows))
    theta = lmscore.initial(v)
    assert len(lmscore.Memory(rows).hot) == 1
    got = {r.doc_id: r for r in lmscore.score(rows, v, theta, part=300).collect()}
    assert len(got) == len(texts)
    seen = collections.defaultdict(collections.Counter)
    split = [(t or "").replace("?", "").split() for t in texts]
    around = [list(zip([None, *w][: len(w)], w, [*w[1:], None][: len(w)], strict=True)) for w in split]
    for a, w, b in (x for own in around for x in own):
        seen[a, b][w] += 1
    for i, own in enumerate(around):
        doc, word = lmscore.words([" ".join(split[i]).encode()])
        p = np.exp(lmscore.log_probabilities(theta, v, doc, lmscore.cells(word)))
        m = np.array([seen[a, b][w] - 1 for a, w, b in own], float)
        d = np.array([sum(seen[a, b].values()) - 1 for a, _, b in own], float)
        assert got[i].n_tokens == len(own) and abs(got[i].pll - np.log((p + m) / (d + 1)).sum()) < 1e-3 * (1 + abs(got[i].pll))
        assert got[i].recalled is None if not own else abs(got[i].recalled - (m > 0).mean()) < 1e-12


def test_every_position_is_trained_on(monkeypatch):
    default = {k: p.default for k, p in inspect.signature(lmscore.train).parameters.items()}
    doc, word = lmscore.words([b" ".join(b"w%d" % (k % 37) for k in range(203))])
    cell = lmscore.cells(word)
    v = lmscore.Vocabulary(np.bincount(cell, minlength=1 << lmscore.BITS).astype(float))
    seen = []
    monkeypatch.setattr(lmscore.Trainer, "step", lambda self, near, target: seen.append(len(target)))
    for turn in range(default["rounds"]):
        lmscore.Trainer(lmscore.initial(v), v).learn(doc, cell, default["rounds"], turn)
    assert sum(seen) == 203


def test_training_raises_likelihood():
    rng = np.random.default_rng(0)
    pairs = [b"red apple", b"blue sky", b"hot sun", b"cold ice"]
    text = b" ".join(pairs[i] for i in rng.integers(0, 4, 4000))
    doc, word = lmscore.words([text])
    cell = lmscore.cells(word)
    v = lmscore.Vocabulary(np.bincount(cell, minlength=1 << lmscore.BITS).astype(float))
    theta = lmscore.initial(v)
    before = lmscore.log_probabilities(theta, v, doc, cell).mean()
    t = lmscore.Trainer(theta, v, batch=256)
    for k in range(4):
        t.learn(doc, cell, 1, k)
    assert lmscore.log_probabilities(t.theta, v, doc, cell).mean() > before + 0.5


def _plain_step(theta, g2, near, target, rate):
    """A step of Adagrad as the formulas stand."""
    p, q, n = lmscore.views(theta), lmscore.views(g2), near.shape[1]
    v = p["e"].take(near, 0)
    h = np.tanh((v * p["d"][:, None]).sum(0) + p["b"])
    z = h @ p["w"] + p["c"]
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True) * np.float32(n)
    z[np.arange(n), target] -= np.float32(1 / n)
    gh = (z @ p["w"].T) * (1 - h * h)
    ge = (gh * p["d"][:, None]).reshape(-1, lmscore.HIDDEN)
    order = np.argsort(near.ravel(), kind="stable")
    ids, first = np.unique(near.ravel()[order], return_index=True)
    for name, g, rows in (("e", np.add.reduceat(ge.take(order, 0), first, axis=0), ids), ("d", (v * gh).sum(1), slice(None)), ("b", gh.sum(0), slice(None)), ("w", h.T @ z, slice(None)), ("c", z.sum(0), slice(None))):
        q[name][rows] += g * g
        p[name][rows] -= rate * g / np.sqrt(q[name][rows])


def _plain_log_probabilities(theta, v, doc, cell):
    p = lmscore.views(theta)
    near = lmscore.neighbours(doc, v.context[cell])
    h = p["e"].take(near[0], 0) * p["d"][0]
    for k in range(1, len(near)):
        h += p["e"].take(near[k], 0) * p["d"][k]
    z = np.tanh(h + p["b"]) @ p["w"] + p["c"]
    z -= z.max(1, keepdims=True)
    return z[np.arange(len(doc)), v.of[cell]] - np.log(np.exp(z).sum(1)) + v.log_within[cell]


def _plain_order(context, word):
    order = np.argsort(context)
    c = context[order]
    tied = np.flatnonzero(np.concatenate((c[1:] == c[:-1], [False])) | np.concatenate(([False], c[1:] == c[:-1])))
    order[tied] = order[tied][np.lexsort((word[order[tied]], c[tied]))]
    return order


def _seconds(f):
    out = []
    for _ in range(7):
        began = time.thread_time()
        f()
        out.append(time.thread_time() - began)
    return min(out)


def test_steps_scores_and_sorts_equal_plain_forms_in_less_cpu_time():
    rng = np.random.default_rng(0)
    word = (np.minimum(rng.zipf(1.3, 50_300), 40_000).astype(np.uint32) * np.uint32(2654435761)).astype(np.uint32)
    doc, cell = np.repeat(np.arange(503), 100), lmscore.cells(word)
    v = lmscore.Vocabulary(np.bincount(cell, minlength=1 << lmscore.BITS).astype(float))
    near, target = lmscore.neighbours(doc, v.context[cell]), v.of[cell].astype(np.int64)
    t = lmscore.Trainer(lmscore.initial(v), v)
    theta, g2 = t.theta.copy(), np.full(lmscore.SIZE, 1e-3, np.float32)
    batches = [(near[:, a : a + t.batch], target[a : a + t.batch]) for a in range(0, len(doc), t.batch)]  # the last is shorter
    for b in batches:
        t.step(*b)
        _plain_step(theta, g2, *b, t.rate)
    assert np.abs(t.theta - theta).max() < 1e-3 and np.abs(t.theta - lmscore.initial(v)).max() > 0.1
    assert np.abs(lmscore.log_probabilities(theta, v, doc, cell) - _plain_log_probabilities(theta, v, doc, cell)).max() < 1e-4
    context = lmscore.contexts(doc, word)
    order, new, first = lmscore._order(context, word)
    plain = _plain_order(context, word)
    assert (context[order] == context[plain]).all() and (word[order] == word[plain]).all() and (np.sort(order) == np.arange(len(doc))).all()
    assert new.sum() == len(np.unique(context)) and first.sum() == len(set(zip(context.tolist(), word.tolist(), strict=True)))
    assert _seconds(lambda: [t.step(*b) for b in batches]) < 0.9 * _seconds(lambda: [_plain_step(theta, g2, *b, t.rate) for b in batches])
    assert _seconds(lambda: lmscore.log_probabilities(theta, v, doc, cell)) < 0.8 * _seconds(lambda: _plain_log_probabilities(theta, v, doc, cell))
    assert _seconds(lambda: lmscore._order(context, word)) < 0.8 * _seconds(lambda: _plain_order(context, word))


def test_large_weights_do_not_overflow():
    doc, word = lmscore.words([b" ".join(b"w%d" % (k % 37) for k in range(203))])
    cell = lmscore.cells(word)
    v = lmscore.Vocabulary(np.bincount(cell, minlength=1 << lmscore.BITS).astype(float))
    near, target = lmscore.neighbours(doc, v.context[cell]), v.of[cell].astype(np.int64)
    t = lmscore.Trainer(lmscore.initial(v), v)
    t.p["w"][:] *= 400
    theta, g2 = t.theta.copy(), np.full(lmscore.SIZE, 1e-3, np.float32)
    got = lmscore.log_probabilities(theta, v, doc, cell)
    assert not lmscore.calm(t.p) and np.isfinite(got).all() and np.abs(got - _plain_log_probabilities(theta, v, doc, cell)).max() < 1e-2
    t.step(near, target)
    _plain_step(theta, g2, near, target, t.rate)
    assert np.abs(t.theta - theta).max() < 1e-2


def test_contexts_that_agree_in_their_upper_bits_are_told_apart():
    for n in (0, 1, 2, 1000):
        context = np.random.default_rng(n).integers(0, 5, n).astype(np.uint64) + np.uint64(7 << 40)
        word = np.random.default_rng(n + 1).integers(0, 3, n).astype(np.uint32) * np.uint32(1 << 31)
        order, new, first = lmscore._order(context, word)
        rows = list(zip(context[order].tolist(), word[order].tolist(), strict=True))
        assert sorted(order.tolist()) == list(range(n)) and rows == sorted(rows)
        assert new.sum() == len({c for c, _ in rows}) and first.sum() == len(set(rows))


def test_mixing_meets_the_limit_and_the_entropy(spark):
    rows = [(i, "w " * 50, "en", "big" if i % 10 else f"small{i % 30 // 10}") for i in range(3000)] + [(9000, None, "en", "empty")]
    d = docs(spark, rows)
    mixed = mixing.mix(d, max_repeats=2.0, block_tokens=2000)
    per = {r.source: r for r in mixed.selectExpr("source", "n_tokens", "n_tokens * epochs as used", "weight").groupBy("source").agg({"n_tokens": "sum", "used": "sum", "weight": "max"}).collect()}
    repeats = {s: r["sum(used)"] / r["sum(n_tokens)"] for s, r in per.items() if s != "empty"}
    assert abs(repeats["big"] - 1) < 1e-9 and all(1.9 < repeats[f"small{k}"] <= 2 for k in range(3))
    used = sum(r["sum(used)"] for r in per.values())
    assert all(abs(r["sum(used)"] / used - r["max(weight)"]) < 0.01 for r in per.values())
    assert mixing.materialise(d, mixed).count() == mixed.agg({"epochs": "sum"}).first()[0]
    totals = mixed.groupBy("source").agg({"n_tokens": "sum"}).toDF("source", "tokens")
    for target in (0.9, 1.0):
        tau, _ = mixing.exponent(totals, None, target)
        p = np.array([r.tokens for r in totals.collect() if r.tokens], float) ** tau
        p /= p.sum()
        assert abs(-(p * np.log(p)).sum() / np.log(len(p)) - target) < 1e-3
    down = mixing.mix(d, budget=20_000.0, block_tokens=2000).selectExpr("sum(n_tokens * epochs) as t").first().t
    assert 19_000 <= down <= 20_000


def test_mixing_against_a_plain_loop(spark):
    """Weights, epochs and permutations recomputed from their definition."""
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 30)), "en", ["big", "mid", "tiny", None][min(3, int(rng.integers(0, 12)) // 4 + (i % 17 == 0))]) for i in range(600)]
    d = docs(spark, rows)
    out = mixing.mix(d, max_repeats=1.5, block_tokens=300).collect()
    total = collections.Counter()
    for _, t, _, src in rows:
        total[src] += len(t.split())
    every = sum(total.values())
    worst = lambda tau: max(p ** (tau - 1) for p in [n / every for n in total.values()]) / min(p ** (tau - 1) for p in [n / every for n in total.values()])
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if worst(mid) <= 1.5 else (mid, high)
    z = sum(n**high for n in total.values())
    weight = {s: n**high / z for s, n in total.items()}
    assert all(abs(r.weight - weight[r.source]) < 1e-5 for r in out)
    budget = max(n / weight[s] for s, n in total.items())
    used, blocks = collections.Counter(), collections.defaultdict(lambda: collections.defaultdict(list))
    for r in out:
        used[r.source] += r.n_tokens * r.epochs
        blocks[r.source][r.block].append(r)
    for s, n in total.items():
        target = budget * weight[s]
        assert target - 31 <= used[s] <= target + 1e-3 * n
        whole = int(target / n + 1e-6)
        # blocks are taken whole up to the one at the edge of the budget
        state = [{r.epochs - whole for r in own if r.n_tokens} for own in blocks[s].values()]
        assert sum(len(x) > 1 for x in state) <= 1 and set().union(*state) <= {0, 1}


def test_templates_against_a_plain_count(spark):
    """Subtrees counted from a tree that html.parser builds; every one over its bar goes, nothing else."""
    from html.parser import HTMLParser

    rng = np.random.default_rng(2)
    shared = ["<div><p>Read the terms of use</p></div>", "<nav><ul><li>Home</li><li>News</li></ul></nav>", "<div><p>Rare note</p></div>"]
    rows = []
    for k in range(30):
        parts = [shared[0]] if k % 2 else []
        parts += [shared[1]] if k % 3 else []
        parts += [shared[2]] if k < 4 else []
        parts.append(f"<div><p>own text {k}</p><p>{rng.integers(1 << 30)}</p></div>")
        rows.append((k, f"http://h.example/{k}", "<html><body>" + "".join(parts) + "</body></html>"))
    rows += [(100 + k, f"http://h.example/c{k}", rows[0][2]) for k in range(20)]  # copies of a page count once
    rows += [(200, "http://other.example/", rows[1][2])]

    class Tree(HTMLParser):
        def __init__(self, html):
            super().__init__()
            self.html, self.open, self.found = html, [], []
            self.feed(html)

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, self.getpos()[1]))

        def handle_endtag(self, tag):
            name, at = self.open.pop()
            if name not in ("html", "body"):
                self.found.append(self.html[at : self.getpos()[1] + len(tag) + 3])

    count, pages = collections.defaultdict(set), set()
    for _, url, html in rows:
        if "h.example" in url:
            pages.add(html)
            for x in Tree(html).found:
                count[x].add(html)
    bad = {x for x, own in count.items() if len(own) >= max(5, 0.1 * len(pages))}
    assert {"<p>Read the terms of use</p>", "<li>Home</li>", shared[0], shared[1]} <= bad and shared[2] not in bad
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert htmltext.templates(d.select(F.lit("h").alias("host"), "html").where("url like '%h.example%'")).count() == len(bad)
    for limit, salt in ((500_000, 50_000), (0, 7)):
        out = {r.page_id: r for r in htmltext.extract(d, broadcast_rows=limit, salt_pages=salt).collect()}
        for i, url, html in rows:
            want = html
            for x in bad if "h.example" in url else ():
                want = want.replace(x, "")
            want = re.sub(r"<nav>.*?</nav>", "", want)
            assert out[i].text == "\n".join(x for x in re.split(r"(?:<[^>]*>)+", want) if x)
            assert out[i].n_templates == (sum(x in bad for x in Tree(html).found) if "h.example" in url else 0)
