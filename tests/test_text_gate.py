"""The text gate on hand-made pictures, and its matching against plain loops."""

import difflib
import random

from pyspark.sql import functions as F

from pickwise.operators import text_gate as op
from pickwise.plans import text_gate as plan

BOX = "image int, box_id int, text string, confidence double, left double, top double, right double, bottom double, valid boolean"


def picture(spark, title, tokens, director=("lana", "wachowski"), size=(1000, 1500)):
    return spark.createDataFrame([(1, *size, title, list(tokens), list(director))], "image int, width int, height int, title string, title_tokens array<string>, director_tokens array<string>")


def row(*texts, top=400.0, tall=100.0, step=150.0, left=100.0, confidence=0.9):
    return [(1, k, t, confidence, left + k * step, top, left + k * step + 80, top + tall, True) for k, t in enumerate(texts)]


def found(spark, rows, title, tokens):
    return {(r["box_id"], r["source"]) for r in op.title_evidence(spark.createDataFrame(rows, BOX), picture(spark, title, tokens)).collect()}


def test_spaced_letters(spark):
    assert {k for k, _ in found(spark, row("A", "L", "I", "E", "N"), "Alien", ["alien"])} == {0, 1, 2, 3, 4}
    assert {k for k, _ in found(spark, row("P", "3", "N", "U", "R"), "Run", ["run"])} == {0, 1, 2, 3, 4}  # scrambled: a band
    assert found(spark, row("X", "Y", "Z"), "Run", ["run"]) == set()
    assert found(spark, row("A", "L", "I", "E", "N", tall=10.0, step=20.0), "Alien Romulus", ["alien", "romulus"]) != set()


def test_words_of_a_line(spark):
    got = found(spark, row("BLADE", "RUN", "NER", "yesterday"), "Blade Runner", ["blade", "runner"])
    assert {k for k, _ in got} == {0, 1, 2} and (1, "line_window") in got
    assert found(spark, [(1, 0, None, 0.9, 0.0, 0.0, 1.0, 1.0, True), (1, 1, "", 0.9, 0.0, 0.0, 1.0, 1.0, True)], "Blade", ["blade"]) == set()


def test_fixed_flags_by_plain_loops():
    """The flags that the queries' SQL states for each text, by the rules in plain Python."""
    title, director = ["matrix", "reloaded"], ["lana", "wachowski"]

    def explained(word, tokens):
        return word in tokens or bool(difflib.get_close_matches(word, tokens, n=1, cutoff=0.6)) or any(t in word for t in tokens if len(t) >= 3) or any(word in t for t in tokens if len(word) >= 3)

    for text, is_title, odd, _, is_format in plan.READ:
        words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
        assert is_format == bool(set(words) & set(op.FORMATS))
        assert is_title == (bool(words) and all(explained(w, title) for w in words)), text
        assert is_title or odd == any(len(w) >= 4 and not w.isdigit() and not explained(w, title + director) for w in words), text


def plain_lines(boxes, high):
    """Each line as (sum of centres, tallest, members), by a plain loop."""
    out = []
    for k, x, y, tall in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
        tall = max(1.0, tall)
        for own in out:
            if abs(y - own[0] / len(own[2])) <= max(0.018 * high, 0.7 * max(tall, own[1])):
                own[0], own[1] = own[0] + y, max(own[1], tall)
                own[2].append(k)
                break
        else:
            out.append([y, tall, [k]])
    return [own[2] for own in out]


def test_lines_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for image in range(30):
        own = [(k, rng.randrange(400), rng.randrange(300) / 2, rng.choice([4.0, 10.0, 30.0])) for k in range(rng.randint(1, 12))]
        rows += [(image, k, x - 5.0, y - t / 2, x + 5.0, y + t / 2, 500) for k, x, y, t in own]
        want |= {(image, k, n) for n, line in enumerate(plain_lines(own, 500)) for k in line}
    df = spark.createDataFrame(rows, "image int, box_id int, left double, top double, right double, bottom double, height int")
    assert {tuple(r) for r in op.same_lines(df).select("image", "box_id", "line").collect()} == want
    assert op.same_lines(df.limit(0)).count() == 0


def plain_bands(boxes, title, tokens, wide, high):
    """Box ids of bands by a plain loop over first and last rows; boxes: (id, letters, left, top, right, bottom)."""
    at = {b[0]: b for b in boxes}
    rows = sorted(plain_lines([(b[0], (b[2] + b[4]) / 2, (b[3] + b[5]) / 2, b[5] - b[3]) for b in boxes], high), key=lambda own: sum((at[k][3] + at[k][5]) / 2 for k in own) / len(own))
    middle = lambda own: sorted(at[k][5] - at[k][3] for k in own)[len(own) // 2]
    taken = set()
    for a in range(len(rows)):
        for z in range(a, len(rows)):
            own = [k for r in rows[a : z + 1] for k in r]
            if z > a and min(at[k][3] for k in rows[z]) - max(at[k][5] for r in rows[a:z] for k in r) > 1.2 * middle(own):
                break
            signs = {ch for k in own for ch in at[k][1] if ch.isalpha()}
            if len(own) < 3 or max(at[k][4] for k in own) - min(at[k][2] for k in own) < 0.18 * wide or middle(own) < 0.035 * high or not signs:
                continue
            shares = [(len(signs & set(t)) / len(set(t)), len(signs & set(t)) / len(signs)) for t in (title, *tokens)]
            covers, own_share = max(shares, key=lambda s: s[0])
            if covers >= 0.55 and own_share >= 0.55 or covers >= 0.40 and own_share >= 0.80:
                taken |= set(own)
    return taken


def test_bands_by_a_plain_loop(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for image in range(60):
        boxes = []
        for k in range(rng.randint(2, 9)):
            left, top, tall = rng.randrange(0, 900, 60), rng.randrange(0, 400, 40), rng.choice([30, 60, 90])
            boxes.append((k, rng.choice("romulusxz") + rng.choice(["", "a"]), float(left), float(top), float(left + 50), float(top + tall)))
        rows += [(image, k, t.upper(), 0.9, left, top, right, bottom, True) for k, t, left, top, right, bottom in boxes]
        want |= {(image, k) for k in plain_bands(boxes, "romulus", ["romulus"], 1000, 1500)}
    b, i = spark.createDataFrame(rows, BOX), spark.createDataFrame([(n, 1000, 1500, "Romulus", ["romulus"], []) for n in range(60)], "image int, width int, height int, title string, title_tokens array<string>, director_tokens array<string>")
    assert want and {tuple(r) for r in op.letter_bands(op.looked_for(b, i)).collect()} == want


def test_directors(spark):
    rows = [(1, "LANA WACHOWSKI"), (2, "lana something"), (3, "nobody here"), (4, "lana and a very long list of other people and names"), (5, "")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("tokens", F.array(F.lit("lana"), F.lit("wachowski"), F.lit("of")))
    assert {r["k"] for r in op.mostly_named(df, ["k"], "text", "tokens").collect()} == {1, 2}


def test_decisions(spark):
    image = picture(spark, "Blade Runner", ["blade", "runner"])
    rows = row("BLADE RUNNER") + [(1, 9, "now in theaters everywhere", 0.9, 300.0, 1400.0, 700.0, 1430.0, True)]
    get = lambda mode, own=rows, **kw: tuple(op.decide(spark.createDataFrame(own, BOX), image, mode, **kw).select("accepted", "reason").first())
    assert get("title_only") == (False, "text_heavy") and get("title_only", most_boxes=1) == (True, None)
    assert get("textless") == (False, "has_title") and get("textless", rows[1:]) == (False, "text_heavy") and get("textless", []) == (True, None)
    assert get("title_only", []) == (False, "no_text") and get("title_only", [(*rows[1][:2], "dolby atmos", *rows[1][3:])]) == (False, "format_blocklist")
    assert get("custom", allow=frozenset({"title", "billing"})) == (True, None) and get("custom") == (False, "text_heavy")
    assert get("custom", rows[1:], allow=frozenset({"title", "billing"})) == (False, "no_title") and get("custom", rows[1:], allow=frozenset({"billing"}), require_title=False) == (True, None)
