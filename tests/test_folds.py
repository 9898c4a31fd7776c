"""Folds that run as rounds of joins, against plain loops in order."""

import random

from pickwise.operators import candidates, exemplars


def plain_fold(log):
    """The log's rows one after another: (exemplar) -> (status, by, until)."""
    out, own, held = {}, {}, {}  # own: subject -> exemplar; held: picture -> exemplar
    rows = {e: (s, p, at, r) for e, s, p, at, r in log}
    ends = sorted((r, e) for e, _, _, _, r in log if r is not None)
    for e, s, p, at, r in sorted(log, key=lambda x: x[3]):
        while ends and ends[0][0] <= at:
            t, gone = ends.pop(0)
            if out.get(gone, ("",))[0] == "active":
                out[gone] = ("revoked", None, t)
                del own[rows[gone][0]], held[rows[gone][1]]
        if p in held:
            out[e] = ("invalid", held[p], None)
            continue
        if s in own:
            before = own[s]
            out[before] = ("revoked", e, at)
            del held[rows[before][1]]
        own[s], held[p], out[e] = e, e, ("active", None, None)
    for t, gone in ends:
        if out[gone][0] == "active":
            out[gone] = ("revoked", None, t)
    return out


def test_one_active_exemplar_a_subject_and_picture(spark):
    rng = random.Random(7)
    for n, subjects, pictures in ((60, 5, 4), (80, 3, 30), (80, 40, 3), (40, 1, 1)):
        log = []
        for at in range(1, n):
            log.append((1000 + at, rng.randrange(subjects), rng.randrange(pictures), at * 10, at * 10 + rng.randrange(5, 300) if rng.random() < 0.3 else None))
        want = plain_fold(log)
        df = spark.createDataFrame(log, "exemplar long, subject long, picture long, at long, revoked long")
        got = {r["exemplar"]: (r["status"], r["by"], r["until"]) for r in exemplars.activate(df).collect()}
        assert got == want


def test_a_chain_of_conflicts(spark):
    # Each picture is free only because its holder's subject chose anew, which again hangs on the one before.
    log = [(k, k // 2, (k + 1) // 2, k + 1, None) for k in range(24)]
    df = spark.createDataFrame(log, "exemplar long, subject long, picture long, at long, revoked long")
    assert {r["exemplar"]: (r["status"], r["by"], r["until"]) for r in exemplars.activate(df).collect()} == plain_fold(log)
    assert exemplars.activate(df.limit(0)).count() == 0


def plain_groups(rows, most):
    """Anchors by a loop: (id, hash, worth) in order of id."""
    anchor = {}
    rows = sorted(rows)
    for i, h, _ in rows:
        if i not in anchor:
            anchor[i] = i
            for j, g, _ in rows:
                if j > i and j not in anchor and h is not None and g is not None and ((h ^ g) & (1 << 64) - 1).bit_count() <= most:
                    anchor[j] = i
    out, worth, hashes = {}, {i: w for i, _, w in rows}, {i: h for i, h, _ in rows}
    for i, a in anchor.items():
        best = max((j for j in anchor if anchor[j] == a), key=lambda j: (worth[j], -j))
        out[i] = (a, best, 0 if hashes[i] is None else ((hashes[i] ^ hashes[best]) & (1 << 64) - 1).bit_count())
    return out


def test_near_duplicates_of_any_group_size(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for subject in ("x", "y"):
        seeds = [rng.getrandbits(64) for _ in range(4)]
        own = []
        for i in range(90):
            h = rng.choice(seeds)
            for _ in range(rng.randrange(9)):
                h ^= 1 << rng.randrange(64)
            own.append((i, None if i % 20 == 7 else h - (1 << 64) if h >> 63 else h, rng.randrange(5)))
        rows += [(subject, *r) for r in own]
        want |= {(subject, i): v for i, v in plain_groups(own, 6).items()}
    df = spark.createDataFrame(rows, "subject string, candidate_id long, phash long, pixels long")
    found = candidates.greedy_near_duplicates(df, 6)
    got = {(r["subject"], r["candidate_id"]): (r["anchor_id"], r["kept_id"], r["distance"]) for r in found.collect()}
    assert got == want and len({a for (_, _), (a, _, _) in got.items()}) > 10
    ledger = {(r["subject"], r["removed_id"], r["kept_id"], r["distance"], r["reason"]) for r in candidates.duplicate_ledger(found).collect()}
    assert ledger == {(s, i, k, d, "dedup_exact" if d == 0 else "dedup_phash") for (s, i), (_, k, d) in want.items() if i != k}
