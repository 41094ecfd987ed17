"""run() against a brute-force version of its stages."""

import collections
import re

import corpus_pipeline
from delver.llm import langid, minhash, mixing
from delver.llm.common import gram_hashes, word_table


def test_stages_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(90001, None, "en", "src1", 0), (90002, "12345 --", "en", "src1", 8), (90003, "", None, None, 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf).persist()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in now.collect()}, out.collect()
        kept = {r.doc_id: r for r in after}
        if name == "language ID":
            model = langid.train(now)
            pred, score = model.predict([r.text for r in before.values()])
            want = {i for i, p, s in zip(before, pred, score, strict=True) if p != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE}
            assert set(kept) == want and not want & {90001, 90002, 90003}
        elif name == "line dedup":
            sites = collections.defaultdict(set)
            for r in before.values():
                for x in r.text.split("\n"):
                    sites[x.strip(" \t\r")].add(r.source)
            bad = {x for x, s in sites.items() if x and len(s) >= 10}
            want = {i: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\r") not in bad) for i, r in before.items()}
            assert {i: r.text for i, r in kept.items()} == {i: t for i, t in want.items() if t == before[i].text or t.strip()}
        elif name == "MinHash near-dedup":
            groups = {r.doc_id: r.group_id for r in minhash.near_duplicates(now).collect()}
            assert set(kept) == set(groups.values())
            bags = {}
            for i, r in before.items():
                w = word_table([r.text.encode()])[4]
                bags[i] = collections.Counter((gram_hashes(w, 2) if len(w) > 1 else w).tolist())
            for i in kept:
                for j in kept:
                    if i < j and bags[i] and bags[j]:
                        assert sum((bags[i] & bags[j]).values()) < 0.8 * sum((bags[i] | bags[j]).values())
        elif name == "benchmark decontamination":
            word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            grams = set()
            for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                w = word.findall(r.text.lower())
                grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
            clean = set()
            for i, r in before.items():
                w = word.findall(r.text.lower())
                if not any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1)):
                    clean.add(i)
            assert set(kept) == clean
        else:
            epochs = {r.doc_id: r.epochs for r in mixing.mix(now).collect()}
            assert collections.Counter(r.doc_id for r in after) == collections.Counter(epochs)
            assert set(epochs.values()) <= {1, 2} and set(kept) == set(before)
        now = out


def test_run_is_registered(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op")}
