"""Quality rules, centroid clusters and conversation repair against plain code."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corpuslake.llm import centroid_clusters as C
from corpuslake.llm import conversation_repair as R
from corpuslake.llm import queries
from corpuslake.llm import quality_rules as Q

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_rules(rows, least, share, depleted):
    """``rows``: (text, host); the counts of each."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(SPACES)).translate({c: c + 32 for c in range(65, 91)})
    texts, seen = defaultdict(set), defaultdict(set)
    for text, host in rows:
        if words_of(text):
            texts[host or ""].add(text)
            for x in text.split("\n"):
                if words_of(x):
                    seen[host or "", norm(x)].add(text)
    bad = {(h, x) for (h, x), found in seen.items() if len(found) >= least and len(found) > share * len(texts[h])}
    out = []
    for text, host in rows:
        t, w = text or "", words_of(text)
        lines = [x for x in t.split("\n") if words_of(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        again = len({k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 8)})
        failed = len(w) < 20 or 100 * again > 30 * len(w)
        gone = [x for x in lines if (host or "", norm(x)) in bad]
        lost = sum(len(words_of(x)) for x in gone)
        clean = text if not gone else "\n".join(x for x in t.split("\n") if x not in gone)
        out.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed, lost, not failed and lost <= depleted * len(w), clean))
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "clean_text"]


def test_quality_rules_against_plain_code(spark):
    rng = random.Random(3)
    common = ["Share this  PAGE now", " all rights reserved © ", "read more & more"]
    rows = [(None, "a"), ("", "a"), (" \t\n ", None), ("été \U0001f600 " * 30, None), ("one two three four five six seven eight " * 9, "b")]
    for i in range(150):
        lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        rows.append(("\n".join(lines + [rng.choice([x, x.lower(), x.replace(" ", "  ")]) for x in common if rng.random() < 0.4]), rng.choice(["a", "a", "b", None])))
    rows += [("Copied line that stands here\nand another line", "c")] * 40  # copies are one document
    rows += [("share this page now\nread more & more\nshort", "a")] * 2 + [("x " * 30_000 + "y\n" + "z " * 30_000, "a")]
    docs = spark.createDataFrame([(i % 50, t, h, "mine", 7) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string, kept string, n_words int")
    found = Q.quality_rules(docs.withColumn("at", F.monotonically_increasing_id()).repartition(7), least=5, share=0.1).orderBy("at")
    assert found.columns == ["doc_id", "text", "source", "at", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "clean_text", "kept"]
    wanted = plain_rules(rows, 5, 0.1, Q.DEPLETED)
    for got, want in zip(found.collect(), wanted, strict=True):
        assert tuple(got[c] for c in NAMES) == want
    assert sum(w[6] > 0 for w in wanted) > 50 and any(not w[7] and not w[5] for w in wanted)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_run_no_python(spark):
    plan = queries.op11_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_nearest(x, centroids):
    found = []
    for v in x.tolist():
        found.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids.tolist())))
    return found


def test_annulus_finds_the_nearest_with_ties():
    rng = np.random.default_rng(5)
    for k, size, top in ((1, 3, 4), (2, 2, 3), (8, 4, 3), (40, 6, 900), (25, 3, 1 << 27)):
        centroids, x = rng.integers(-top, top, (k, size)), rng.integers(-top, top, (300, size))
        centroids[-1] = centroids[0]
        x[:20] = centroids[rng.integers(0, k, 20)]
        number, d = C.nearest_centroids(x, centroids)
        assert list(zip(d.tolist(), number.tolist())) == plain_nearest(x, centroids)


def test_clusters_of_odd_rows(spark):
    v = lambda *head: [float(h) for h in head] + [0.0] * (64 - len(head))
    rows = [(1, v(1)), (1, v(1)), (2, v(-0.0001)), (3, v(5, 5)), (3, v(5, 6)), (None, v(9)), (4, None), (5, v(float("nan"))), (6, [1.0]), (7, v(float("inf"))), (8, [None] + [0.0] * 63), (9, v(1e30)), (10, [])]
    table = spark.createDataFrame([(i, x, "l", 5) for i, x in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    found = C.centroid_digests(table.repartition(3)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in found) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 3), (True, None)]
    # As many centroids as vectors: each is its own, the repeated one belongs to the smaller number.
    assert all(r["distance"] == r["inertia"] == r["cluster_inertia"] == 0 for r in found)
    ones = {r["cluster"] for r in found if r["vec_id"] == 1}
    assert len(ones) == 1 and len({r["cluster"] for r in found}) == 5
    digest = hashlib.sha256(",".join(["-1"] + ["0"] * 63).encode()).hexdigest()
    assert [r["centroid_sha256"] for r in found if r["vec_id"] == 2] == [digest]
    assert C.centroid_digests(table.limit(0)).count() == 0


def test_clusters_move_by_floors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(4)]) for i in range(200)]
    found, centroids = C.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, size=4, scale=16, rounds=4)
    ints = {i: np.floor(16 * np.array(x)).astype(int) for i, x in rows}
    order = sorted(ints, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:5]
    plain = np.array([ints[i] for i in order])
    x = np.array([ints[i] for i in range(200)])
    for _ in range(4):
        number = [n for _, n in plain_nearest(x, plain)]
        plain = np.array([[int(s) // number.count(c) for s in x[np.array(number) == c].sum(axis=0)] if c in number else plain[c].tolist() for c in range(5)])
    assert (plain == centroids).all()
    assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in found.collect()} == dict(enumerate(plain_nearest(x, plain)))


def plain_repair(rows):
    """``rows``: (turn, role, text) after damage, any order; the result by trying all edits at each place."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not words_of(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    memo: dict = {}

    def rest(i, state, inserts=0):
        key = (i, state, inserts)
        if key in memo:
            return memo[key]
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        add = lambda price, letter, tail, said: found.append((tail[0] + price, letter + tail[1], (*said, *tail[2]))) if tail else None
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", rest(i + 1, state), ())
            if faults[i] in ("", "truncated"):
                extra = 5 * (faults[i] == "truncated")
                if (state, initials[i]) in step:
                    add(extra, "K", rest(i + 1, step[state, initials[i]]), (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        add(1 + extra, "R", rest(i + 1, step[state, new[0]]), (f"{new}:{text}",))
        for new in ("user", "assistant"):
            if inserts < 3 and (state, new[0]) in step:
                add(5, "I", rest(i, step[state, new[0]], inserts + 1), (f"{new}:",))
        memo[key] = min(found) if found else None
        return memo[key]

    for i in range(len(rows), -1, -1):  # from the end, so that the recursion stays shallow
        for state in ("", "s", "u", "a"):
            rest(i, state)
    price, audit, said = rest(0, "")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, price, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_damage(rows):
    """``rows``: (conv, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    return out


def compare(found, rows):
    wanted = {conv: plain_repair(own) for conv, own in plain_damage(rows).items()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[c] for c in names) for r in found.collect()}
    assert found.count() == len(wanted) and got == wanted
    return wanted


KIND = "conv_id long, turn long, role string, text string"


def test_conversations_of_the_table_against_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = compare(queries.op13_conversations(spark, DATA), rows)
    assert len({w[6] for w in wanted.values()}) > 15


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_of_odd_rows(spark, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "cut", "cut off", "", " \n", None, "a.b", "é ?\t"]
    roles = ["system", "user", "assistant", "tool", "", None, "uncle", "user", "assistant", "user", "assistant"]
    rows = []
    for conv in [None, *range(200)]:
        for i in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            rows.append((conv, rng.choice([None, i, i, i, i // 2, 3 * i, -i]), rng.choice(roles), rng.choice(texts) or rng.choice(texts)))
    rows += rows[::7]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", cost int, audit string").repartition(5)
    compare(R.repaired(table), rows)


def test_a_hot_conversation_crosses_ranges(spark, monkeypatch):
    """One conversation lies in many ranges, others at their borders; the same row very often."""
    rng = random.Random(9)
    rows = [(5, i, rng.choice(["user", "assistant", "assistant", "tool", "system"]), f"t{rng.randint(0, 150)}{rng.choice('.!?x')}") for i in range(400)]
    rows += [(5, 7, "user", "again.")] * 300 + [(c, i, ["user", "assistant"][i % 2], f"w{i}.") for c in (1, 2, 8, 9) for i in range(9)]
    monkeypatch.setattr(R, "RANGE", 1500)
    found = R.repaired(spark.createDataFrame(rows, KIND).repartition(4))
    wanted = compare(found, rows)
    assert wanted[5][5] > 100 and len(wanted[5][6]) > 650


def test_all_rows_dropped_and_empty_table(spark):
    gone = [(c, t) for c in range(200) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(*g, "user", "Hi.") for g in gone]
    wanted = compare(R.repaired(spark.createDataFrame(rows, KIND)), rows)
    assert set(wanted.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repaired(spark.createDataFrame([], KIND)).count() == 0
