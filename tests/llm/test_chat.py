import itertools
import random

from quillseek.llm import chat


def brute(roles):
    """Least cost over all ways: each turn emitted as a role after up to two empty turns, or merged."""
    legal = lambda s: all(b in chat.NEXT[a] for a, b in zip((chat.START, *s), s))
    best = None
    empties = [(), (1,), (2,), (1, 2), (2, 1)]

    def go(i, seq, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(roles):
            for e in empties:
                full = (*seq, *e)
                if full and full[-1] == 2 and legal(full):
                    c = cost + chat.INSERT * len(e)
                    best = c if best is None else min(best, c)
            return
        r = chat.role_index(roles[i])
        price = lambda to: chat.NAME if r < 0 else chat.RELABEL * (r != to)
        for e in empties:
            for to in (0, 1, 2):
                full = (*seq, *e, to)
                if legal(full):
                    go(i + 1, full, cost + chat.INSERT * len(e) + price(to))
        if seq:
            go(i + 1, seq, cost + chat.MERGE + price(seq[-1]))

    go(0, (), 0)
    return best


def valid(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body))


def test_brute_force():
    kinds = ["system", "user", "assistant", None]
    cases = [c for n in range(1, 4) for c in itertools.product(kinds, repeat=n)]
    rng = random.Random(1)
    cases += [tuple(rng.choices(kinds, k=n)) for n in (4, 5) for _ in range(60)]
    for roles in cases:
        cost, out = chat.repair([(r, f"t{i}") for i, r in enumerate(roles)])
        assert cost == brute(roles), roles
        assert valid([r for r, _ in out]), (roles, out)
        texts = "\n\n".join(t for _, t in out if t)
        assert texts == "\n\n".join(f"t{i}" for i in range(len(roles)))  # nothing lost, order kept


def test_repairs():
    run = lambda *roles: (lambda x: (x[0], [r for r, _ in x[1]]))(chat.repair([(r, "x") for r in roles]))
    assert run("user", "assistant") == (0, ["user", "assistant"])
    assert run("user", "user", "assistant") == (1, ["user", "assistant"])
    assert run("user") == (3, ["user", "assistant"])
    assert run("Human", " GPT ") == (0, ["user", "assistant"])
    assert chat.repair([]) == (0, [])
    assert chat.repair([("user", None), ("user", "a"), ("assistant", "b")])[1] == [("user", "a"), ("assistant", "b")]


def test_render():
    assert chat.render([("user", "a <|end|> b"), ("assistant", "")]) == "<|user|>\na < |end|> b<|end|>\n<|assistant|>\n<|end|>\n"


def test_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, "q"), (2, None, "tool", None), (None, 3, "user", "z"), (1, 1, "assistant", "b"), (3, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, roles string, cost int")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].roles == "user,assistant" and got[1].given_turns == 3 and got[1].cost == 1 and "b\n\nb" in got[1].rendered
    assert set(got) == {1, 2, 3, None} and got[None].cost == 3 and "y" * 200_000 in got[3].rendered
    assert got[2].given_turns == 2 and got[2].roles == "user,assistant"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation():
    rng = random.Random(2)
    cost, out = chat.repair([(rng.choice(["user", "assistant", None]), "x") for _ in range(3000)])
    assert valid([r for r, _ in out]) and cost > 0
