import itertools
import random

from quillspark.llm import chat, queries


def brute_cost(roles):
    """Least cost over all choices, by trying them."""
    best = {0: 0}
    for role in roles:
        r = role.strip().lower() if role else ""
        new = {}
        for state, cost in best.items():
            for target in (1, 2, 3):
                change = 0 if chat.ROLES[target] == r else chat.RELABEL if r in chat.ROLES[1:] else chat.UNKNOWN
                for inserted in ((), (1,), (2,), (3,)):
                    seq, s, ok = [*inserted, target], state, True
                    for x in seq:
                        ok, s = ok and x in chat.NEXT[s], x
                    if ok:
                        new[target] = min(new.get(target, 10**9), cost + change + chat.INSERT * len(inserted))
                if target == state:
                    new[target] = min(new.get(target, 10**9), cost + change + chat.MERGE)
        best = new
    return min(c + (0 if s in chat.FINAL else chat.INSERT) for s, c in best.items())


def check(rows, out):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = {}
    for r in out:
        got.setdefault(r.conv_id, []).append(r)
    assert sorted((r[0] is None, r[0] or 0, str(r[1]), str(r[2])) for r in rows) == sorted((r.conv_id is None, r.conv_id or 0, str(r.turn), str(r.role)) for r in out)
    key = lambda r: tuple((x is not None, x) for x in r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: key(r[1:]))
        rs = got[conv]
        rs.sort(key=lambda r: key((r.turn, r.role)))
        cost = brute_cost([t[2] for t in turns])
        assert sum(r.cost for r in rs) == cost and {r.conv_cost for r in rs} == {cost}


def replay(rs):
    """Rendered pieces make a legal conversation with the texts in order."""
    text = "".join(r.rendered for r in rs)
    turns = [x.split("|>\n", 1) for x in text.split("<|end|>\n") if x]
    roles = [t[0].removeprefix("<|") for t in turns]
    state = 0
    for role in roles:
        s = chat.ROLES.index(role)
        assert s in chat.NEXT[state]
        state = s
    assert state in chat.FINAL
    return turns


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op1_chat_format(spark, sf_dir).collect()
    check(rows, out)
    by = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    given = {}
    for r in sorted(rows):
        given.setdefault(r[0], []).append(r[3] or "")
    for conv, rs in by.items():
        turns = replay(rs)
        # Texts stay whole and in order; merged ones share a turn, inserted ones are empty.
        want = []
        for r, text in zip(rs, given[conv]):
            want += [""] * (r.inserted.count(",") + 1 if r.inserted else 0)
            if "merge" in r.action:
                want[-1] += "\n" + text
            else:
                want.append(text)
        assert [t[1] for t in turns][: len(want)] == want and [t[1] for t in turns][len(want) :] in ([], [""])


def test_wide_ids_beside_nulls_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    r = random.Random(9)
    big = 9007199254740993
    rows = [(big, t, r.choice(["user", "assistant", "x", None, " System\n"]), f"b{t}") for t in range(400)]
    rows += [(None, None, r.choice(["user", "assistant"]), f"n{t}") for t in range(60)]
    rows += [(c, t, r.choice(chat.ROLES[1:]), f"{c}.{t}") for c in range(150) for t in range(r.randint(1, 20))]
    rows += [(big + 1, 1, "user", "same")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in ("10000", "13"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            out = chat.repair(df).collect()
            check(rows, out)
            replay(sorted((x for x in out if x.conv_id == big), key=lambda x: x.turn))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_short_sequences_and_blocks(spark, monkeypatch):
    roles = ["system", "user", "assistant", "tool", None]
    rows, conv = [], 0
    for n in (1, 2, 3):
        for seq in itertools.product(roles, repeat=n):
            rows += [(conv, t, r, f"t{t}") for t, r in enumerate(seq)]
            conv += 1
    r = random.Random(3)
    rows += [(conv, t, r.choice(roles), "x") for t in range(3 * chat.BLOCK + 5)]
    rows += [(None, 1, "USER ", None), (None, None, "assistant", ""), (conv + 1, 5, "user", "same"), (conv + 1, 5, "user", "same")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "conv_id long, turn long, role string, text string, block int")
    out = chat.repair(df).collect()
    check(rows, out)
    own = sorted((x for x in out if x.conv_id == conv), key=lambda x: x.turn)
    replay(own)
    same = [x for x in out if x.conv_id == conv + 1]
    assert "".join(x.rendered for x in sorted(same, key=lambda x: "merge" in x.action)) == "<|user|>\nsame\nsame<|end|>\n"
    assert chat.repair(df.limit(0)).collect() == []
