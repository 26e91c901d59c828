import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm.overlap import _blocks, _candidates, fingerprint, overlap_report, record_pairs, same_article, title_parts, titled

SCHEMA = "article_id long, title string, split string, url string"


def pairs(spark, rows):
    df = spark.createDataFrame([(i, t, s, "https://en.site.example/wiki/x") for i, t, s in rows], SCHEMA).withColumn("class", F.lit("clash")).withColumn("core", F.lit("c"))
    return {(r.eval_id, r.train_id) for r in record_pairs(titled(df, "article_id", "title", "split", "url"), "article_id").collect()}


SAME = [
    ("Gorvén Lặmtac Pliđeb", "gorven_lamtac_plideb"), ("Gorvén Lặmtac Pliđeb", "“Gorvén Lặmtac Pliđeb” [edit]"), ("Battle of Gorven", "The Battle  of Gorven – Lorepedia"), ("Gorven Lamtac", "Gorven-Lamtac | Lorepedia, the open lore book"),
    ("Gorven Lamtac Plideb", "Gorvn Lamtac Plideb"), ("Gorven Lamtac Plideb", "Gorvenn Lamtac Plideb"), ("Gorven Lamtac Plideb", "Gorqen Lamtac Plideb"), ("Gorven Lamtac Plideb", "Govren Lamtac Plideb"), ("Gorven Lamtac", "Gorven Lamtac (song)"), ("Gorven Lamtac (Nym Pav song)", "GORVEN LAMTAC [NYM PAV SONG]"),
]
OTHER = [
    ("Gorven Lamtac I", "Gorven Lamtac II"), ("Battle of Gorven (1200)", "Battle of Gorven (1201)"), ("Gorven (Nym Pav song)", "Gorven (Tac Wil song)"), ("Gorven Lamtac", "Gorven Lamtac dynasty"), ("Gorven 12", "Gorven 13"), ("Gorven Lamtac", "Pavtac Lamtac"), ("Air", "Fir"),
]


def test_rules(spark):
    rows = []
    for k, (a, b) in enumerate(SAME + OTHER):
        tag = f" {chr(97 + k)}{chr(113 + k % 9) * 3}{chr(98 + k)}ox"  # keeps the cases apart
        a, b = (t if "(" in t or "[" in t or "|" in t or "–" in t or t[-1] in "I23”" or len(t) < 5 else t for t in (a, b))
        rows += [(2 * k, a, "test"), (2 * k + 1, b, "train")]
    for k, (a, b) in enumerate(SAME + OTHER):
        got = pairs(spark, [(1, a, "val"), (2, b, "train")]) if k in (0, 6, 9, len(SAME), len(SAME) + 1) else None
        if got is not None:
            assert bool(got) == (k < len(SAME)), (a, b)
    alone = {(2 * k, 2 * k + 1) for k in range(len(SAME))}
    got = pairs(spark, rows)
    assert alone <= got and not {(2 * k, 2 * k + 1) for k in range(len(SAME), len(SAME) + len(OTHER))} & got


@pytest.mark.parametrize("seed", range(2))
def test_one_slip_is_always_found(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwyz ") for _ in range(rng.randrange(14, 40))).strip()
        at = rng.randrange(1, len(t) - 1)
        kind = rng.randrange(3)
        s = t[:at] + ("" if kind == 0 else "q" if kind == 1 else t[at] + "q") + t[at + 1 :]
        rows += [(2 * i, t, "train"), (2 * i + 1, s, "val")]
    got = pairs(spark, rows)
    from quillmill.llm.overlap import title_parts

    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, t string")
    num = {r.i: r.n for r in df.select("i", title_parts(F.col("t"))["numerals"].alias("n")).collect()}
    want = {(2 * i + 1, 2 * i) for i in range(300) if num[2 * i] == num[2 * i + 1]}
    assert len(want - got) <= 2


def slip(rng, t):
    at = rng.randrange(len(t) - 1)
    kind = rng.randrange(4)
    if kind == 3:
        return t[:at] + t[at + 1] + t[at] + t[at + 2 :]
    return t[:at] + ("" if kind == 0 else "q" if kind == 1 else t[at] + "q") + t[at + 1 :]


@pytest.mark.parametrize("shortest, longest", [(5, 13), (12, 16), (16, 21), (21, 38), (38, 44), (44, 90)])
def test_accepted_pairs_are_all_found(spark, shortest, longest):
    rng = random.Random(shortest)
    rows = []
    for i in range(250):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwyz") for _ in range(rng.randrange(shortest, longest)))
        s = slip(rng, t) if i % 5 == 0 else slip(rng, slip(rng, t))
        rows += [(2 * i, t, "train"), (2 * i + 1, s, "val")]
    got = pairs(spark, rows)
    df = spark.createDataFrame(rows, "i long, t string, s string").select("i", "s", *[c.alias(n) for n, c in title_parts(F.col("t")).items()])
    left, right = (df.filter(keep).select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, keep in (("l", "s = 'val'"), ("r", "s = 'train'")))
    want = {(r.l_i, r.r_i) for r in left.crossJoin(right).filter(same_article("l", "r")).select("l_i", "r_i").collect()}
    assert len(want) > 50 and got == want, (len(want), len(want - got), len(got - want))


@pytest.mark.parametrize("seed", range(5))
def test_an_edit_turns_few_bits(seed):
    rng = random.Random(seed)
    for _ in range(200):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 40)))
        at = rng.randrange(len(t))
        s = t[:at] + rng.choice(["", "x", t[at] + "x"]) + t[at + 1 :]
        assert (fingerprint(t)[0] ^ fingerprint(s)[0]).bit_count() <= 4
    a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(2))
    assert (fingerprint(a)[0] ^ fingerprint(b)[0]).bit_count() > 16  # others lie outside the radius
    code, held = fingerprint(a)
    assert sum(held) == 31 and _blocks(code, held) and not _blocks(*fingerprint("ab"))


def test_salted_blocks_lose_nothing(spark):
    rng = random.Random(2)
    tail = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    train = [(i, "historyofthetown" + tail()) for i in range(600)]  # one half is shared by all
    held = [(1000 + i, slip(rng, t)) for i, t in train[:60]]
    t, h = (spark.createDataFrame(x, "cid long, core string") for x in (train, held))
    plain = {tuple(r) for r in _candidates(t, h).collect()}
    assert {tuple(r) for r in _candidates(t, h, per_task=50).collect()} == plain
    assert {tuple(r) for r in _candidates(t, h, sample_rows=200, per_task=50).collect()} == plain >= {(1000 + i, i) for i in range(60)}


def test_hot_title_dirt_and_report(spark):
    rows = [(i, "Hot Title Here", "train" if i % 2 else "test") for i in range(60)] + [(100, None, "val"), (101, "", "val"), (102, "Hot Title Here", None), (103, "Hot Title Here", ""), (104, "x" * 20000, "val"), (105, "[edit]", "train")]
    got = pairs(spark, rows + rows[:5])
    assert len(got) == 900
    df = spark.createDataFrame([(i, t, s, "https://www.site.example/a") for i, t, s in rows], SCHEMA)
    rep = overlap_report(titled(df, "article_id", "title", "split", "url"), "article_id").collect()
    assert {(r.split, r.source, r.records, r.overlapping) for r in rep} == {("test", "site.example", 30, 30), ("val", "site.example", 1, 0)}
    assert pairs(spark, [(1, "a", "train")]) == set() and record_pairs(titled(df.filter("false"), "article_id", "title", "split", "url"), "article_id").count() == 0
