"""Collocations by contiguous pattern growth.

1. Words are counted by language over all texts. Rare words end every phrase; a bit table of fixed size tells the rest of
   the work which words may be frequent (a false hit only carries more).
2. Projection: each occurrence of a two-word prefix goes, with the words to its right, to the task of that prefix. Equal
   occurrences of a slice of text travel as one with a count, packed in blocks with the slice's own word list.
3. Growth: a task holds its prefixes' occurrence pointers and extends each frequent phrase to the right, depth first: the
   pointers of a phrase are put in order by their next word, and each next word that is frequent is a phrase with pointers
   of its own.
4. Cuts, absorption into longer phrases, scores and ranks are joins and windows over the table of frequent phrases.

A prefix that holds a large share of all occurrences (at most HEAVY of them exist at any size of the table) is grown in
many tasks: its occurrences go by one word more, and its own count travels by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, save, slices

STOP = b"\xff"  # stands in no UTF-8 text
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", STOP * 10)
SPOTS = 2**24  # bits of the table of frequent words
ROOM = 1_000_000  # occurrences that a task grows at once, about
HEAVY = 8192  # a prefix with a larger share than one in so many is split
LONGEST = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """word -> number from 1, in order of appearance; 0 ends a phrase."""

    def __init__(self):
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def split(texts: list[bytes]) -> list[bytes]:
    """The words of all texts, A-Z lower-cased, with STOP between pieces and texts."""
    return b"\n".join(texts).lower().translate(PIECES).replace(STOP, b" " + STOP + b" ").split()


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Words, np.ndarray]]:
    """Language, word list and word numbers of each bounded slice of a batch (lang, text)."""
    for lo, hi in slices(batch, 6_000_000):
        part, own = batch.slice(lo, hi - lo), {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if text:
                own.setdefault(lang, []).append(text)
        for lang, texts in own.items():
            words = Words()
            yield lang, words, words.numbers(split(texts))


def spot(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\xff" + word) % SPOTS


def counted(docs: DataFrame) -> DataFrame:
    """lang, phrase, spot, count of all words, and of word pairs and triples (spot null) that are heavy in a slice."""
    kinds = pa.schema({"lang": pa.string(), "phrase": pa.binary(), "spot": pa.int32(), "count": pa.int64()})

    def put(total: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([None if b" " in k[1] else spot(*k) for k in keys], pa.int32()), pa.array(total.values(), pa.int64())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bytes], int] = {}
        for batch in batches:
            for lang, words, x in by_language(batch):
                names, n = list(words), np.bincount(x, minlength=len(words))
                for word, c in zip(names[1:], n[1:].tolist(), strict=True):
                    total[lang, word] = total.get((lang, word), 0) + c
                # What is heavy in a slice: both ends must be heavy words, which leaves few to count.
                share = 2 + len(x) // (2 * HEAVY)
                code, valid, often = x, x > 0, n > share
                for k in (2, 3):
                    code = code[: len(x) - k + 1] * len(words) + x[k - 1 :] if k <= len(x) else code[:0]
                    valid = valid[: len(code)] & (x[k - 1 :] > 0)
                    u, c = np.unique(code[valid & often[x[: len(code)]] & often[x[k - 1 :]]], return_counts=True)
                    for v, m in zip(u[c > share].tolist(), c[c > share].tolist(), strict=True):
                        parts = []
                        for _ in range(k):
                            v, last = divmod(v, len(words))
                            parts.append(names[last])
                        phrase = b" ".join(parts[::-1])
                        total[lang, phrase] = total.get((lang, phrase), 0) + m
                if len(total) > 1_000_000:
                    yield put(total)
                    total = {}
        yield put(total)

    return docs.mapInArrow(run, "lang string, phrase binary, spot int, count long").groupBy("lang", "phrase", "spot").agg(F.sum("count").alias("count"))


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * _MIX
    return h ^ (h >> np.uint64(32))


def packed(rows: np.ndarray, count: np.ndarray) -> bytes:
    """Rows in order of their first word, and their counts, column by column: the first as steps, all in the narrowest width."""
    columns = np.concatenate([np.diff(rows[:, :1], axis=0, prepend=0), rows[:, 1:], count[:, None]], axis=1)
    kind = "<u2" if len(rows) and 0 <= columns.min() and columns.max() < 2**16 else "<i8"
    return kind[1:].encode() + zlib.compress(columns.T.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns = np.frombuffer(zlib.decompress(data[2:]), dtype="<" + data[:2].decode()).reshape(LONGEST + 1, -1).astype(np.int64)
    columns[0] = np.cumsum(columns[0])
    return columns[:LONGEST].T, columns[LONGEST]


def projected(docs: DataFrame, table: np.ndarray, heavy: dict[str, list[tuple[bytes, ...]]], buckets: int) -> DataFrame:
    """bucket, lang, kind, words, windows: the occurrences of two-word prefixes with what follows, by the prefix's bucket.

    windows: `packed` rows of four word numbers (0: the phrase has ended) with counts; words: the names, from number 1,
    compressed. kind 0: occurrences to grow; kind 1: counts of heavy prefixes, to add up.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((table, heavy))  # SPOTS bits and at most a few thousand prefixes
    kinds = pa.schema({"bucket": pa.int64(), "lang": pa.string(), "kind": pa.int32(), "words": pa.binary(), "windows": pa.binary()})

    def listed(rows: np.ndarray, count: np.ndarray, bucket: np.ndarray, lang: str, kind: int, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(bucket, kind="stable")
        rows, count, bucket = rows[by], count[by], bucket[by]
        edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, dtype=np.int64)
        out: list[list] = [[], [], []]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            used, inverse = np.unique(rows[a:b], return_inverse=True)
            at = 1 if used[0] == 0 else 0
            local = inverse.reshape(b - a, LONGEST) + (1 - at)
            out[0].append(int(bucket[a]))
            out[1].append(zlib.compress(b"\n".join(names[i] for i in used[at:].tolist()), 1))
            out[2].append(packed(local, count[a:b]))
        if out[0]:
            m = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([lang] * m), pa.array([kind] * m, pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lists = shared.value
        for batch in batches:
            for lang, words, x in by_language(batch):
                names = list(words)
                spots = np.array([0, *(spot(lang, w) for w in names[1:])])
                often = (bits[spots >> 3] >> (spots & 7)) & 1 > 0
                often[0] = False
                x = np.where(often[x], x, 0)
                x = np.concatenate([x, np.zeros(LONGEST, dtype=np.int64)])
                at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
                rows = np.stack([x[at], x[at + 1], x[at + 2], np.where(x[at + 2] > 0, x[np.minimum(at + 3, len(x) - 1)], 0)], axis=1)
                v = len(names)
                head, tail = rows[:, 0] * v + rows[:, 1], rows[:, 2] * v + rows[:, 3]
                by = np.lexsort((tail, head))
                head, tail, rows = head[by], tail[by], rows[by]
                new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]))[: len(rows)]
                count, head, rows = np.diff(np.append(new, len(rows))), head[new], rows[new]
                if not len(rows):
                    continue
                h = np.array([xxhash.xxh3_64_intdigest(w) for w in names], dtype=np.uint64)
                route = mixed(mixed(np.full(len(rows), xxhash.xxh3_64_intdigest(lang.encode()), dtype=np.uint64), h[rows[:, 0]]), h[rows[:, 1]])
                pairs = {words[a] * v + words[b] for a, b, *c in lists.get(lang, ()) if not c and a in words and b in words}
                triples = {(words[a] * v + words[b], words[c[0]]) for a, b, *c in lists.get(lang, ()) if c and all(w in words for w in (a, b, *c))}
                if pairs:
                    split_ = np.isin(head, list(pairs))
                    wide = split_ & (rows[:, 2] > 0)
                    own = mixed(route, h[rows[:, 2]])
                    deep = np.zeros(len(rows), dtype=bool)
                    for a, c in triples:
                        deep |= split_ & (head == a) & (rows[:, 2] == c)
                    plain = np.where(deep, mixed(own, h[rows[:, 3]]), np.where(wide, own, route))
                    lone = split_ & ~wide  # the pair alone: only its count matters, which travels below
                    # Heavy pairs and triples count by themselves.
                    for mask, width, where in ((split_, 2, route), (deep, 3, own)):
                        if mask.any():
                            short = rows[mask] * (np.arange(LONGEST) < width)
                            u, first, inverse = np.unique(short, axis=0, return_index=True, return_inverse=True)
                            sums = np.zeros(len(u), dtype=np.int64)
                            np.add.at(sums, inverse.reshape(-1), count[mask])
                            yield from listed(u, sums, where[mask][first] % np.uint64(buckets), lang, 1, names)
                    keep = ~lone & ~(deep & (rows[:, 3] == 0))
                    rows, count, route = rows[keep], count[keep], plain[keep]
                yield from listed(rows, count, route % np.uint64(buckets), lang, 0, names)

    return docs.mapInArrow(run, "bucket long, lang string, kind int, words binary, windows binary")


def grow(rows: np.ndarray, count: np.ndarray, least: int, heavy: set[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every phrase of 2 to LONGEST words with a count of at least `least`, from occurrence pointers into rows; depth first.
    Heavy phrases are grown, but their counts are not told: other tasks have others of their occurrences."""
    stack: list[tuple[tuple[int, ...], np.ndarray]] = [((), np.arange(len(rows)))]
    while stack:
        phrase, at = stack.pop()
        k = len(phrase)
        word = rows[at, k]
        if k == 0:
            word = word * (rows.max(initial=0) + 1) + rows[at, 1]
        elif not word.all():
            at, word = at[word > 0], word[word > 0]
        if not len(at):
            continue
        by = np.argsort(word, kind="stable")
        at, word = at[by], word[by]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = np.add.reduceat(count[at], first)
        end = np.append(first[1:], len(at))
        own = [phrase + ((int(rows[at[a], 0]), int(rows[at[a], 1])) if k == 0 else (int(word[a]),)) for a in first.tolist()] if heavy else None
        grown = total >= least
        if heavy:
            grown |= np.array([p in heavy for p in own])
        for i in np.flatnonzero(grown)[::-1].tolist():
            a = first[i]
            p = own[i] if heavy else phrase + ((int(rows[at[a], 0]), int(rows[at[a], 1])) if k == 0 else (int(word[a]),))
            if p not in heavy:
                yield p, int(total[i])
            if len(p) < LONGEST:
                stack.append((p, at[a : end[i]]))


def grown(blocks: DataFrame, least: int, heavy: dict[str, list[tuple[bytes, ...]]], partitions: int) -> DataFrame:
    """lang, phrase, words, f of every frequent phrase of two words and more, by the projected blocks of each bucket."""
    shared = blocks.sparkSession.sparkContext.broadcast(heavy)
    kinds = pa.schema({"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "f": pa.int64()})

    def settle(lang: str, kind: int, held: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        words, parts = Words(), []
        for names, windows in held:
            own = np.concatenate([[0], words.numbers(zlib.decompress(names).split(b"\n"))])
            x, count = unpacked(windows)
            parts.append((own[x], count))
        rows, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        known = {tuple(words[w] for w in p) for p in shared.value.get(lang, ()) if all(w in words for w in p)}
        names = list(words)
        if kind:
            u, inverse = np.unique(rows, axis=0, return_inverse=True)
            total = np.zeros(len(u), dtype=np.int64)
            np.add.at(total, inverse.reshape(-1), count)
            found = [(tuple(w for w in p if w), t) for p, t in zip(u.tolist(), total.tolist(), strict=True) if t >= least]
        else:
            found = list(grow(rows, count, least, known))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([b" ".join(names[w] for w in p).decode() for p, _ in found]), pa.array([len(p) for p, _ in found], pa.int32()), pa.array([t for _, t in found], pa.int64())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if held:
                        yield from settle(key[1], key[2], held)
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield from settle(key[1], key[2], held)

    placed = blocks.repartition(partitions, "bucket").sortWithinPartitions("bucket", "lang", "kind")
    return placed.mapInArrow(run, "lang string, phrase string, words int, f long")


def phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of every phrase of 1 to 4 words that occurs at least `least` times in its language, and lang, n: each language's words.

    docs(text, lang): null langs count as `und`, null texts as empty.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counts = save(counted(own), "words")
    single = counts.where(F.col("spot").isNotNull())
    sizes = single.groupBy("lang").agg(F.sum("count").alias("n"))
    often = single.where(F.col("count") >= least)
    table = np.zeros(SPOTS // 64, dtype=np.int64)
    slots = often.groupBy(F.shiftright("spot", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, spot % 64))").alias("bits"))
    for r in slots.toLocalIterator():  # SPOTS / 64 rows at most
        table[r["slot"]] = r["bits"]
    total = single.agg(F.sum("count")).first()[0] or 0
    # Each of these holds more than one in 2 * HEAVY of all words, so that there are no more than 2 * HEAVY of a length.
    large = counts.where(F.col("spot").isNull() & (F.col("count") > max(least, total // (2 * HEAVY), ROOM // 32))).select("lang", "phrase").collect()
    heavy: dict[str, list[tuple[bytes, ...]]] = {}
    for r in large:
        heavy.setdefault(r["lang"], []).append(tuple(bytes(r["phrase"]).split(b" ")))
    for own_ in heavy.values():  # a triple is split only below a split pair
        pairs = {p for p in own_ if len(p) == 2}
        own_[:] = [p for p in own_ if len(p) == 2 or p[:2] in pairs]
    buckets = max(16, total // ROOM)
    partitions = max(16, min(buckets, 100_000))
    longer = grown(projected(own, table.view(np.uint8), heavy, buckets), least, heavy, partitions)
    shorter = often.select("lang", F.decode("phrase", "UTF-8").alias("phrase"), F.lit(1).alias("words"), F.col("count").alias("f"))
    found = save(shorter.unionByName(longer), "phrases")
    sizes = save(sizes, "sizes")
    discard(counts)
    return found, sizes


def part(phrase: str, first: int, last: int) -> F.Column:
    """Words first to last (from 1) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language of docs(text, lang) that hold together best.

    Arithmetic is in whole numbers, products in decimals of 38 digits. Null langs count as `und`, null and empty texts
    hold no words, rows that repeat count each time, ties follow score, count and the phrase's bytes; an empty table gives
    none; other columns are not read.
    """
    found, sizes = phrases(docs, least)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    known = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    many = found.where("words > 1")
    # Cuts: the lowest score counts, of equal ones the first.
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = many.select("lang", "phrase", "words", F.col("f").alias("a"), k.alias("k"))
    cuts = cuts.withColumns({"left": part("phrase", 1, F.col("k")), "right": part("phrase", F.col("k") + 1, F.col("words"))})
    cuts = cuts.join(known.withColumnsRenamed({"part": "left", "part_f": "l"}), ["lang", "left"]).join(known.withColumnsRenamed({"part": "right", "part_f": "r"}), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.score", "c.a", "c.l", "c.r")
    # Absorbed: a longer phrase around it keeps at least four fifths of its count.
    inside = many.where("words > 2").select("lang", "f", F.col("phrase").alias("longer"), "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s")).select("lang", part("longer", F.col("s"), F.col("s") + F.col("m") - 1).alias("phrase"), "f")
    around = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * 80))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
named AS (SELECT lang, row_number() OVER () AS pid, string_split_regex(piece, '[ \t]+') AS w FROM pieces),
words AS (SELECT * FROM (SELECT lang, pid, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM named) WHERE w <> ''),
next AS MATERIALIZED (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY pid ORDER BY pos)),
runs AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM next UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM next WHERE w4 IS NOT NULL),
sizes AS MATERIALIZED (SELECT lang, count(*) AS n FROM runs WHERE m = 1 GROUP BY 1),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 30),
parts AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
ways AS (SELECT *, unnest(range(1, m)) AS k FROM parts),
halves AS MATERIALIZED (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM ways),
cuts AS (
  SELECT h.lang, h.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.x JOIN f r ON r.lang = h.lang AND r.phrase = h.y),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes_of AS (SELECT *, unnest(range(2, m)) AS q FROM parts), places AS (SELECT *, unnest(range(1, m - q + 2)) AS s FROM sizes_of),
inside AS MATERIALIZED (SELECT lang, array_to_string(w[s:s + q - 1], ' ') AS phrase, max(f) AS most FROM places GROUP BY 1, 2),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * s.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
