import random

from tessella.sources import sessions


def test_log_against_replay(spark):
    rng = random.Random(3)
    table = {(k, j): (rng.choice(["a", None]), k) for k in range(8) for j in range(3) if rng.random() < 0.6}
    log, state = [], dict(table)
    for seq in range(120):
        key, op, a, b = (rng.randrange(8), rng.randrange(3)), rng.choice(["put", "patch", "patch", "delete"]), rng.choice([None, f"v{seq}"]), rng.choice([None, seq])
        log.append((*key, a, b, op, seq))
        if op == "put":
            state[key] = (a, b)
        elif op == "delete":
            state.pop(key, None)
        elif key in state:
            old = state[key]
            state[key] = (a if a is not None else old[0], b if b is not None else old[1])
    t = spark.createDataFrame([(*k, *v) for k, v in table.items()], "s int, m int, a string, b int")
    d = spark.createDataFrame(log, "s int, m int, a string, b int, op string, seq int").repartition(4)
    for upto, want in ((120, state), (0, table)):
        got = {(r.s, r.m): (r.a, r.b) for r in sessions.apply_log(t, d.where(f"seq < {upto}"), ["s", "m"]).collect()}
        assert got == want


def test_sessions_listed_and_deleted(spark):
    s = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "session_id int, updated_at int")
    m = spark.createDataFrame([(1, 1), (1, 2), (3, 7)], "session_id int, turn int")
    assert [(r.session_id, r.messages, r.last_turn) for r in sessions.list_sessions(s, m).collect()] == [(2, 0, None), (3, 1, 7), (1, 2, 2)]
    left = sessions.delete_sessions({"sessions": s, "messages": m}, s.where("session_id = 1").select("session_id"))
    assert {k: sorted(r[0] for r in d.collect()) for k, d in left.items()} == {"sessions": [2, 3], "messages": [3]}
