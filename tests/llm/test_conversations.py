import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from breaklens.llm import conversations as C
from breaklens.llm.conversations import damaged, lightest, repair_conversations, repaired_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind2 string, audit int"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(WHITE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen
                   else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, most=None):
    """All edit sequences by brute force: the least (cost, audit) and its lines."""
    bad = faults(rows)
    most = len(rows) + 1 if most is None else most
    best = None
    for n in range(most + 1):  # inserted turns
        for spots in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            for edits in itertools.product(*("D" if b in ("blank", "duplicate") else "DKR" for b in bad)):
                audit, roles, lines, cost = "", "", [], 0

                def put(letter, role=None, text=""):
                    nonlocal audit, roles
                    audit += letter
                    if letter != "D":
                        name = role if role is not None else (
                            "user" if roles in ("", "s") or roles[-1] == "a" else "assistant")
                        roles += name[:1] or "?"
                        lines.append(f"{name}:{text}")
                for i in range(len(rows) + 1):
                    for _ in range(spots.count(i)):
                        put("I")
                        cost += 3
                    if i < len(rows):
                        e = edits[i]
                        cost += {"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and bad[i] == "truncated" else 0)
                        put(e, rows[i][0] if e == "K" else None, rows[i][1])
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def report(rows, turns):
    bad = faults(rows)
    cost, audit, lines = cheapest(rows)
    known = [t for t in turns if t is not None]
    pairs = zip(rows, rows[1:])
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, bad.count("blank"), bad.count("duplicate"),
            bad.count("truncated"), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def draw(rng, n):
    texts = ["Yes.", "No!", "cut off", " \t", "", "Why?", "end.  ", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "usher", ""]
    return [(rng.choice(roles), rng.choice(texts) + (str(rng.randrange(9)) + "." if rng.random() < .5 else ""))
            for _ in range(n)]


def test_lightest_equals_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 3, 4):
        for _ in range(6):
            rows = draw(rng, n)
            marks = tuple((r[:1] if r[:1] in "sua" else "", {"": "+", "truncated": "!"}.get(f, "-"))
                          for (r, _), f in zip(rows, faults(rows)))
            ((_, cost, audit, _),) = lightest((("", 0, ""),), marks, True)
            assert (cost, audit) == cheapest(rows)[:2], rows


def test_blocks_give_what_one_block_gives(monkeypatch):
    rng = random.Random(5)
    for trial in range(60):
        rows = draw(rng, rng.randrange(1, 40))
        seen, told = set(), []
        for size in (1, 3, 1000):
            monkeypatch.setattr(C, "BLOCK_ROWS", size)
            c, seen = C._Conversation(), set()
            for i, (role, text) in enumerate(rows):
                c.add(i, role, text, (role, text) in seen)
                seen.add((role, text))
            told.append(c.report())
        assert told[0] == told[1] == told[2]


def damage(rows):
    """Rows (conv, turn, role, text) after damage, plainly."""
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    from breaklens.llm.queries import op12_conversations
    rng = random.Random(11)
    rows = [(c, t + (t > 2), *draw(rng, 1)[0]) for c in range(120) for t in range(rng.randrange(1, 5))]
    rows += [(500, None, None, "Hi."), (500, None, "user", None), (500, 3, "user", "Hi."), (None, 1, "user", "x."),
             (None, 2, "assistant", "y."), (501, None, "user", "a."), (502, 7, "assistant", "same."),
             (502, 7, "assistant", "same.")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversations(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    after = damage(rows)
    for conv in got:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        assert got[conv] == report([r[2:] for r in mine], [r[1] for r in mine]), (conv, mine)


def test_all_rows_gone_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 1, "user", "x", "", 0), (1, 2, "user", "x", "", 0)], SCHEMA)
    (r,) = repair_conversations(rows, gone=F.lit(True)).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(rows.limit(0)).count() == 0


def test_repaired_turns_hash_to_the_report(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(c, t, *draw(rng, 1)[0], "", 0) for c in range(40) for t in range(9)], SCHEMA)
    bad, gone = damaged(rows)
    reports = repair_conversations(bad, gone=gone)
    lines = {}
    for r in sorted(repaired_turns(bad, reports, gone=gone).collect(), key=lambda r: (r.conv_id, r.line)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in reports.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(30_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    (r,) = repair_conversations(rows).collect()
    assert r.cost == 0 and r.audit == "K" * 30_000


def test_one_exchange(spark):
    rows, gone = damaged(spark.createDataFrame([(1, 1, "user", "x", "", 0)], SCHEMA))
    plan = repair_conversations(rows, gone=gone)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
