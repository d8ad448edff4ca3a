import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import prefix_trie as pt
from tidemark.llm.common import table
from tidemark.llm.queries import op11_prefix_trie

SF = "/root/testdata/sf0.01"
CHATS = "conv_id long, turn long, role string, text string, depth string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], CHATS)


def rebuilt(rows):
    """{conv_id: turns} by plain lists; turns of one number stand by the digest of role and text."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows):
    """All nodes by walking every prefix of every conversation, and every subtree from each of its nodes."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    below = defaultdict(lambda: [0, 0])
    children = defaultdict(int)
    for prefix in sorted(members, key=len, reverse=True):
        if prefix:
            children[prefix[:-1]] += 1
    for prefix in members:
        saved = (len(members[prefix]) - 1) * (len(prefix[-1][1].encode().split()) if prefix else 0)
        for d in range(len(prefix) + 1):
            below[prefix[:d]][0] += not children[prefix]
            below[prefix[:d]][1] += saved
    for prefix, found in members.items():
        ends = sorted(c for c in found if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(found), len(prefix), parent, len(found), children[prefix], *below[prefix], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def test_registered_query_matches_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = op11_prefix_trie(spark, SF)
    assert found.columns == COLUMNS and all(t == "bigint" for c, t in found.dtypes if c != "ends_sha256")
    assert nodes(found) == brute(rows)


def chats(seed, n=400, words=3):
    """Conversations of few different turns, so that they share prefixes, end within each other and repeat."""
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join("ab"[: rng.randrange(1, words)] for _ in range(2))) for c in rng.sample(range(2000), n) for t in range(rng.randrange(1, 6))]


@pytest.mark.parametrize("moduli,bases", [(pt.MODULI, pt.BASES), ((7, 11), (3, 2)), ((3, 3), (1, 2))])
def test_collisions_are_split(spark, moduli, bases):
    """Fingerprints of a few values collide everywhere; the nodes stay the same."""
    rows = chats(1, 80)
    assert nodes(pt.trie(make(spark, rows), pt.Polynomials(moduli, bases))) == brute(rows)


def test_small_batches_carry_on(spark):
    """Families, heads and conversations that go on over batches of three rows."""
    rows = chats(2, 40) + [(40, t, "user", f"long {t}") for t in range(50)] + [(41, t, "user", f"long {t}") for t in range(50)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3",):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert nodes(pt.trie(make(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_many_that_end_at_one_node(spark):
    rows = [(c, 0, "user", "same words here") for c in range(0, 60_000, 20)]
    assert nodes(pt.trie(make(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "x " * 50_000), (0, 1, "user", "x " * 50_000), (None, 1, "user", "no conversation"), (1, 1, "a", "b"), (1, 1, "a", "b"),
        (7, 0, "user", "only turn"), (2005, 0, "u", "turnless when its first turns come from a family that is absent"), (2005, None, "u", "null first"), (3000, 2, "", "x"), (3000, 2, "x", ""),
    ]
    assert nodes(pt.trie(make(spark, rows))) == brute(rows)
    assert pt.trie(make(spark, [])).collect() == []
