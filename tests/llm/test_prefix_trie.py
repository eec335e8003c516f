import hashlib
import random
import zlib

import duckdb
import pytest

import oracle
from tallyforge.llm import prefix_trie, queries

COLUMNS = "conv_id long, turn int, role string, text string"


def brute_trie(rows):
    """Every node from the rebuilt conversations themselves, with texts as keys."""
    digest = lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()[:32]
    by: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    plain = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    rebuilt = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(plain.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:])
    members: dict = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = set()
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = lambda m: sum(len(x) == len(m) + 1 and x[: len(m)] == m for x in members)
        ends = ",".join(map(str, sorted(c for c in ids if len(rebuilt[c]) == len(node))))
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), kids(node), sum(not kids(m) for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def stored(spark, tmp_path, rows, columns=COLUMNS):
    spark.createDataFrame(rows, columns).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def found(spark, folder):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = [tuple(r[c] for c in names) for r in queries.QUERIES["op12_prefix_trie"](spark, folder).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def odd_rows():
    rng = random.Random(12)
    texts = ["", "hi", "é\U00010400", "x" * 50_000, None]
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for c in [*range(0, 12), *range(95, 106), -1, -99, -100, -150, 250, 7_000_000_001] for t in range(rng.randrange(1, 9))]
    rows += [(3, None, "user", "hi"), (3, 2, "user", "tie"), (3, 2, "bot", "tie"), (None, 0, "user", "lost")]
    return rows + rows[:5]  # repeated rows are turns of their own


def test_trie_equals_brute_force_and_sql(spark, tmp_path):
    rows = odd_rows()
    folder = stored(spark, tmp_path, rows)
    assert found(spark, folder) == brute_trie(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    oracle.check(queries.QUERIES["op12_prefix_trie"], queries.SQL["op12_prefix_trie"], spark, folder, con)


def test_common_conversations_of_many_families(spark, tmp_path, monkeypatch):
    """One conversation that most families hold, and ids joined in chunks of three."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, t, "user", f"common {t}") for c in range(0, 4000, 37) for t in range(6 + (c % 5 == 0))] + [(c, 0, "user", str(c)) for c in range(1, 4000, 211)]
    assert found(spark, stored(spark, tmp_path, rows)) == brute_trie(rows)


def test_a_long_conversation(spark, tmp_path):
    rows = [(5, t, "user", str(t)) for t in range(3000)] + [(0, 0, "a", "b")]
    got = found(spark, stored(spark, tmp_path, rows))
    h = zlib.crc32(b"5") % 6
    assert max(r[1] for r in got) == 3000 - h + min(h, 1) and all(r[5] in (1, 2) for r in got)


def test_no_conversations_and_turnless_ones(spark, tmp_path):
    assert found(spark, stored(spark, tmp_path, [])) == set()
    short = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(short, 0, "user", "own, replaced by nothing")]
    assert found(spark, stored(spark, tmp_path, rows)) == brute_trie(rows) == {(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())}


def test_clashing_columns(spark, tmp_path):
    rows = [(*r, "x", 1) for r in odd_rows()[:40]]
    folder = stored(spark, tmp_path, rows, COLUMNS + ", key string, family int")
    assert found(spark, folder) == brute_trie([r[:4] for r in rows])


@pytest.mark.parametrize("partitions", [1, 7])
def test_end_digests(spark, partitions):
    rows = [(bytes([k]), i) for k in range(3) for i in range(-20, 900 * (k == 1) + 10)]
    got = prefix_trie.end_digests(spark.createDataFrame(rows, "key binary, conv_id long"), partitions).collect()
    want = {bytes([k]): hashlib.sha256(",".join(str(i) for kk, i in rows if kk[0] == k).encode()).hexdigest() for k in range(3)}
    assert {bytes(r.key): r.sha256 for r in got} == want and len(got) == 3
