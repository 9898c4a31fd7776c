"""Tokens, packing, mixing, token files, chat: against brute force and round trips, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pickwise.llm import chat, mixing, packing, token_files
from pickwise.llm.tokens import encoder

ODD = [None, "", "  a  b\n\n c\t\td '  's it's <|endoftext|> x", "\x1c a\x1d", "á è İstanbul 　 x", "1234 5,6 ½ ²", "   ", "don't 'll \n 'll", "x" * 300 + " y", "日本 語 テスト\n\n", "a\xa0b \xa0 c", "Σίσυφος ΣΑΣ", "ﬁne é ÅÅ ŉ"]
DOCS = "doc_id long, text string, source string, extra int, size int, target string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    e = encoder(name)
    want = [[] if t is None else e.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode(ODD)] == want


@given(st.text(alphabet=st.sampled_from("aZé .,'\n\t|<>1² ́İſ"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(name)
        assert np.frombuffer(e.encode([text])[0], dtype="<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
@settings(max_examples=150, deadline=None)
def test_plans_hold(histogram):
    bins, seen = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, at in packing.plan(histogram, 60):
        seen[length].append((lo, hi))
        for k in range(hi - lo):
            bins[first + k].append((at, length))
    for length, n in histogram.items():
        assert sum(hi - lo for lo, hi in seen[length]) == n
        assert [lo for lo, _ in sorted(seen[length])] == [0, *[hi for _, hi in sorted(seen[length])]][: len(seen[length])]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 60 and sum(3 * n > 60 for _, n in own) <= 2


def test_packing(spark, data):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "no id", "s"), (3, "same id", "s"), (3, "same id", "s"), (99, "word " * 5000, "s")]
    got = packing.pack(docs(spark, rows)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, _ in rows:
        ids = ([] if text is None else t.encode(text, add_special_tokens=False).ids) + [0]
        want += [(i, k // 2048, k, len(c), zlib.crc32(np.array(c, dtype="<u4").tobytes())) for k in range(0, len(ids), 2048) for c in [ids[k : k + 2048]]]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) == -(-total // 2048)
    assert packing.pack(docs(spark, [])).count() == 0


def test_token_files(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(5, "twice", "s"), (None, "no id", "s"), (-(2**63), "the least", "s")]
    manifest = token_files.write(docs(spark, rows), file_bytes=120)
    got = sorted(token_files.read(spark, manifest, with_ids=True).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda x: ([] if x is None else t.encode(x, add_special_tokens=False).ids) + [0]
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(str(ids(x)) for _, x, _ in rows)
    known = [r["doc_id"] for r in got]
    assert known[0] is None and known[1:] == sorted(known[1:])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in got)
    assert token_files.read(spark, token_files.write(docs(spark, []))).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)) if i % 9 else None, rng.choice(["a", "b", "ä", None, "tiny"] if i % 50 == 0 else ["a", "b", "ä", None])) for i in range(600)]
    rows += [(700, "x y", "a"), (700, "x y", "a"), (None, "p q r", "b"), (701, "", "empty"), (702, None, "empty")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    open_, target, left = set(order), {}, float(sum(size.values()))
    while True:
        share = left / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if share * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    for s, x in by.items():
        assert x[0]["source_size"] == size[s] and x[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in x) - target[s]) <= max(r["size"] for r in x) / 2 + 1e-6
    again = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs(spark, [])).count() == 0
    weighted = mixing.mix(docs(spark, rows).withColumn("m", F.col("doc_id") % 5 + 1), merit=F.col("m")).collect()
    assert sum(r["taken"] for r in weighted if r["source"] == "a") == pytest.approx(target["a"], abs=30)


CHAT = "conv_id long, turn long, role string, text string, leaf_id int, up int"


def digest(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
    learnt = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>", "<|", "<\\\\|x", "", None, "a\nb<|im_start|>user\n", "é日本"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(7, None, None, "x"), (7, 0, "assi\nstant<n|", "y"), (8, 1, "user", "dup"), (8, 1, "user", "dup"), (9, 0, "assistant", "long " * 1000), (9, 1, "assistant", "more")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "still none")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], CHAT)
    got = {r["conv_id"]: tuple(r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in chat.read_back(chat.format_trees(chat.thread(df), part_chars=900)).collect()}
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[r[0]].append(r)
    assert got == {k: digest(v) for k, v in want.items()}
    assert chat.read_back(chat.format_trees(chat.thread(df.limit(0)))).count() == 0


def test_reply_trees(spark):
    m = [("c", 1, None, "user", "q", 0.0), ("c", 2, 1, "assistant", "a", 1.0), ("c", 3, 1, "assistant", "b", 5.0), ("c", 4, 2, "user", "more", 1.0), ("c", 5, 99, "user", "lost parent", None), ("d", 1, 2, "user", "ring", 0.0), ("d", 2, 1, "user", "ring", 0.0), ("d", 3, 1, "user", "hangs on the ring", 0.0)]
    m += [("e", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    df = spark.createDataFrame(m, "conv_id string, msg_id long, parent_id long, role string, text string, score double")
    p = defaultdict(list)
    for r in chat.paths(df).collect():
        p[r["conv_id"], r["leaf_id"], r["branch"]].append((-r["up"], r["msg_id"]))
    got = {k: [m for _, m in sorted(v)] for k, v in p.items()}
    assert got == {("c", 3, 1): [1, 3], ("c", 4, 2): [1, 2, 4], ("c", 5, 3): [5], ("e", 36, 1): list(range(37))}
    best = chat.format_trees(df, branches=1).where("conv_id = 'c'").collect()
    assert [r["formatted"] for r in best] == ["<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"]
    assert [best[0]["formatted"][a:b] for a, b in best[0]["loss"]] == ["b"]
    assert re.findall(chat.TURN, best[0]["formatted"])[1] == ("assistant", "b")
