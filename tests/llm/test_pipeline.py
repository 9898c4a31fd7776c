"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pickwise.llm import language, toxicity
from pickwise.llm.common import load, save


def test_stages(spark, data):
    docs = load(spark, data, "documents", corpus_pipeline.COLUMNS)
    labels = load(spark, data, "labels")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = save(stage(spark, seen[-1], data), name)
        assert name == "packing" or out.columns == docs.columns
        seen.append(out)
    rows = [[r.asDict() for r in d.collect()] for d in seen]
    ids = [Counter(r["doc_id"] for r in x) for x in rows]

    score = toxicity.fit(docs, labels).scorer()
    assert ids[1] == Counter(r["doc_id"] for r in rows[0] if score(r["text"]) < 0.7) and len(rows[1]) < len(rows[0])
    predict = language.fit(seen[1]).predict
    told = zip(rows[1], *predict([r["text"] for r in rows[1]]), strict=True)
    assert ids[2] == Counter(r["doc_id"] for r, lang, p in told if lang != "und" and p >= 0.3)

    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {r["doc_id"]: sh(r["text"]) for r in rows[2]}
    group = {i: i for i in s}
    for a in sorted(s):
        for b in s:
            if a < b and s[a] and s[b] and 100 * (k := len(s[a] & s[b])) >= 80 * (len(s[a]) + len(s[b]) - k) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    assert ids[3] == Counter(set(group.values()))

    size = {r["doc_id"]: len((r["text"] or "").split()) for r in rows[3]}
    source = {r["doc_id"]: r["source"] for r in rows[3]}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    taken, whole = defaultdict(int), defaultdict(int)
    for i, n in ids[3].items():
        whole[source[i]] += size[i] * n
    for i, n in ids[4].items():
        taken[source[i]] += size[i] * n
    weight = {x: (1, 2, 3)[k % 3] for k, x in enumerate(sorted(whole))}
    open_, left, target = set(whole), float(sum(whole.values())), {}
    while over := {x for x in open_ if left * weight[x] / sum(weight[y] for y in open_) > 3 * whole[x]}:
        target |= {x: 3.0 * whole[x] for x in over}
        left -= sum(3 * whole[x] for x in over)
        open_ -= over
    target |= {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
    for x in whole:
        assert abs(taken[x] - target[x]) <= max(size[i] for i in size if source[i] == x)

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(r["length"] for r in rows[5]) == tokens
    places = defaultdict(list)
    for r in rows[5]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-tokens // 2048) * 1.02 + 1


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
