import hashlib
import random
import zlib

import pytest

from plantlens.llm import prefix_trie as P
from verify import duck

ROW = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The nodes by their definition, from lists of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[:len(path)] == path]
        ends = sorted(c for c in members if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(q) == len(path) + 1 for q in below),
                    sum(not any(x[:-1] == q for x in nodes if x) for q in below),
                    sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed, n_convs, most, texts="aé🙂"):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]) if rng.random() < 0.2 else "user", rng.choice(texts) * rng.randint(1, 2))
            for c in range(n_convs) if rng.random() < 0.9 for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed,n_convs,most,texts", [(1, 60, 14, "aé🙂"), (2, 40, 30, "a"), (3, 25, 4, "abcdefgh")])
def test_trie_matches_brute_force(spark, seed, n_convs, most, texts):
    rows = made(seed, n_convs, most, texts)
    random.Random(seed).shuffle(rows)
    assert rows_of(P.trie(spark.createDataFrame(rows, ROW).repartition(3))) == brute(rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", None), (7, 1, "user", ""), (8, None, "user", "b"), (8, None, "user", "a"),
            (8, 3, "user", "a"), (8, 3, "user", "a"), (8, 3, "user", "a"), (11, 0, None, "ü" * 60_000), (12, 0, "", "ü" * 60_000), (5, 9, "user", "z")]
    df = spark.createDataFrame(rows, ROW).selectExpr("*", "1 AS depth", "2 AS f1", "'x' AS a", "0 AS n", "'y' AS base")
    assert rows_of(P.trie(df)) == brute(rows)


def test_turnless_conversations_end_in_the_root(spark):
    turnless = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:3]
    rows = [(c, 0, "user", "only") for c in turnless]  # no base: the head is empty and the own turn is left out
    got = rows_of(P.trie(spark.createDataFrame(rows, ROW)))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 3 and got[0][5] == 1


def test_empty_table(spark):
    assert P.trie(spark.createDataFrame([], ROW)).count() == 0
    assert P.trie(spark.createDataFrame([(None, 1, "user", "x")], ROW)).count() == 0


@pytest.fixture
def many_partitions(spark):
    """Small partitions are not joined to one."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_one_long_conversation_over_many_partitions(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(P, "STRETCH", 16)
    monkeypatch.setattr(P, "PIECE", 3)
    rng = random.Random(9)
    rows = [(50, t, "user", rng.choice("ab")) for t in range(120)] + [(53, t, "user", rng.choice("ab")) for t in range(90)]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]
    assert rows_of(P.trie(spark.createDataFrame(rows, ROW).repartition(5))) == brute(rows)


def test_carried_products_equal_one_pass(spark, many_partitions):
    rows = [(1, t, "user", f"t{t % 7}") for t in range(400)]
    turns = P._hashed(spark.createDataFrame(rows, ROW), 0)
    own = P._products(turns, P.Lanes(0)).orderBy("k").collect()
    assert len({r.part for r in own}) > 1 and [r.k for r in own] == list(range(1, 401))
    value = [0] * 4
    for r in own:
        value = [(v * b + h % p) % p for v, b, p, h in zip(value, P.Lanes(0).base, P.PRIMES, (r.a, r.a, r.b, r.b))]
        assert (r.f1, r.f2) == (value[0] << 31 | value[1], value[2] << 31 | value[3])
    assert [r.pb for r in own] == [2 * k for k in range(1, 401)]


def test_collisions_are_seen(spark, monkeypatch):
    rows = made(4, 60, 12, "abcdefgh")
    monkeypatch.setattr(P, "PRIMES", (3, 5, 3, 5))
    with pytest.raises(RuntimeError, match="collide"):
        P.trie(spark.createDataFrame(rows, ROW)).count()


def test_another_seed_after_a_collision(spark, monkeypatch):
    rows = made(5, 20, 6)
    seen = []
    monkeypatch.setattr(P, "_equal_contents", lambda turns, real=P._equal_contents: bool(seen.append(1)) or len(seen) > 1 and real(turns))
    assert rows_of(P.trie(spark.createDataFrame(rows, ROW))) == brute(rows) and len(seen) == 2


def test_node_turns_refer_to_the_last_turn(spark):
    rows = made(6, 40, 12, "abcd")
    df = spark.createDataFrame(rows, ROW)
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((role, text))
    built = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9:] for c, v in own.items()}
    for r in P.node_turns(P.trie(df), df).collect():
        if r.depth:
            assert own[r.turn_conv_id][r.turn_number - 1] == built[r.conv_id][r.depth - 1]
        else:
            assert r.turn_conv_id is None


def test_oracle_equals_brute_force_on_the_table(sf):
    con = duck(sf)
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    cur = con.execute(P.ORACLE)
    names = [d[0] for d in cur.description]
    got = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()), key=str)
    assert got == brute(rows)
