"""Chat formatting by minimum-cost role repair.

Legal conversations are: at most one system turn, first; then user and
assistant in turn, the user first; the assistant last. A dynamic program over
this automaton chooses for every given turn whether it keeps its role, takes
another or is merged into the turn before it, and where empty turns are put in,
so that the whole costs least. The result is rendered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, key_type, quoted, table

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}
#: Costs: putting an empty turn in, giving a known role another, giving a null or unknown one a role, merging.
INSERT, RELABEL, NAME, MERGE = 3, 2, 1, 1
START = 3  # the state before any turn; the others are the role of the last turn
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}


def _inserts(state: int) -> dict[int, tuple[int, ...]]:
    """State after the fewest empty turns: those turns' roles. No system turn is put in."""
    found, edge = {state: ()}, [state]
    while edge:
        s = edge.pop(0)
        for n in NEXT[s]:
            if n and n not in found:
                found[n] = (*found[s], n)
                edge.append(n)
    return found


def _moves() -> dict[tuple[int, int], list[tuple[int, int, tuple[int, ...], bool]]]:
    """(state, given role): [(next state, cost, empty turns before, merged)], for each next state the cheapest, merging last among equals."""
    out = {}
    for state in (0, 1, 2, START):
        for role in (0, 1, 2, -1):
            best: dict[int, tuple[int, tuple[int, ...], bool]] = {}
            label = lambda to, role=role: NAME if role < 0 else RELABEL * (role != to)
            for mid, empty in _inserts(state).items():
                for to in NEXT[mid]:
                    cost = INSERT * len(empty) + label(to)
                    if to not in best or cost < best[to][0]:
                        best[to] = (cost, empty, False)
            if state != START and (state not in best or MERGE + label(state) < best[state][0]):
                best[state] = (MERGE + label(state), (), True)
            out[state, role] = [(to, *best[to]) for to in sorted(best)]
    return out


MOVES = _moves()
ENDS = {s: _inserts(s).get(2, ()) for s in (0, 1, 2, START)}


def role_index(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def repair(turns: list[tuple[str | None, str | None]]) -> tuple[int, list[tuple[str, str]]]:
    """(cost, [(role, text)]) of the cheapest legal conversation for the given (role, text) turns.

    Null text is empty. Of equal ways, the one whose states come first is taken.
    No turn gives no turn, at no cost.
    """
    if not turns:
        return 0, []
    at: dict[int, int] = {START: 0}
    back: list[dict[int, tuple[int, tuple[int, ...], bool]]] = []
    for role, _ in turns:
        r, new, how = role_index(role), {}, {}
        for state in sorted(at):
            for to, cost, empty, merged in MOVES[state, r]:
                if to not in new or at[state] + cost < new[to]:
                    new[to], how[to] = at[state] + cost, (state, empty, merged)
        at = new
        back.append(how)
    total, state = min((c + INSERT * len(ENDS[s]), s) for s, c in at.items())
    steps, tail = [], ENDS[state]
    for how, (_, text) in zip(reversed(back), reversed(turns)):
        before, empty, merged = how[state]
        steps.append((state, empty, merged, text or ""))
        state = before
    out: list[tuple[str, list[str]]] = []
    for role, empty, merged, text in reversed(steps):
        if merged:
            out[-1][1].append(text)
        else:
            out += [(ROLES[e], [""]) for e in empty]
            out.append((ROLES[role], [text]))
    out += [(ROLES[e], [""]) for e in tail]
    return total, [(r, "\n\n".join(t for t in texts if t)) for r, texts in out]


def render(turns: list[tuple[str, str]]) -> str:
    """Each turn as <|role|>, its text and <|end|>; "<|" in a text becomes "< |"."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}<|end|>\n" for role, text in turns)


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, given_turns, cost, roles, rendered), a row for each conversation.

    Turns are taken by number (null first), then role, then text, so that ties
    and repeated rows have one order; repeated rows are turns of their own. Null
    ids are one conversation; ids keep their type. Null or unknown roles get a
    role at cost NAME. Texts of any length are rendered whole; a conversation is
    a row. Other columns aren't read; an empty table gives an empty one.
    """
    turns = conversations.groupBy(id_key(conversations, id_col).alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(quoted(turn_col).alias("turn"), quoted(role_col).cast("string").alias("role"), quoted(text_col).cast("string").alias("text")))).alias("turns")
    )
    lists = turns.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [repair(list(zip(r, t))) for r, t in zip(b["roles"], b["texts"])]
            yield pd.DataFrame({"conv_id": b["conv_id"], "given_turns": [len(r) for r in b["roles"]], "cost": [c for c, _ in got], "roles": [",".join(r for r, _ in t) for _, t in got], "rendered": [render(t) for _, t in got]})

    out = lists.mapInPandas(run, f"conv_id {key_type(conversations, id_col)}, given_turns int, cost int, roles string, rendered string")
    return out.withColumn("conv_id", id_back(conversations, id_col, F.col("conv_id")))


def query(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))
