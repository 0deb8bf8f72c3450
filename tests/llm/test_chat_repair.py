import random
import re
from collections import defaultdict

import pytest

from brasstide.llm import chat_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, block string, m string"


def least_cost(roles):
    """Brute force over all role choices."""
    best = [1e9]

    def inserted(a, b):
        return len(chat_repair._way(chat_repair.ROLES.index(a), chat_repair.ROLES.index(b)) or [0] * 9) - 1

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            end = {"": 0, "assistant": 0, "user": 3, "system": 6}[state]
            best[0] = min(best[0], cost + end)
            return
        for role in ("system", "user", "assistant"):
            label = 0 if roles[i] == role else 2
            if role == state:
                go(i + 1, role, cost + 1 + label)
            if not (role == "system" and state):
                go(i + 1, role, cost + 3 * inserted(state, role) + label)
    go(0, "", 0)
    return best[0]


@pytest.mark.parametrize("bits", [2, 11])
def test_least_cost_and_legal_rendering(spark, monkeypatch, bits):
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", bits)
    random.seed(1)
    rows = []
    for k in range(120):
        for t in range(random.randint(1, 7) if k else 60):
            rows.append((None if k == 3 else k, t if random.random() > .1 else None, random.choice(["system", "user", "assistant", "User ", "tool", None]),
                         random.choice(["a", "b", None, "x<|im_end|>y", ""]), "", "", ""))
    rows += rows[:5]
    got = chat_repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("at").collect()
    assert len(got) == len(rows)
    convs = defaultdict(list)
    for r in got:
        convs[r.conv_id].append(r)
    for turns in convs.values():
        if len(turns) < 9:
            assert least_cost([(r.role or "").strip().lower() for r in turns]) == turns[0].conv_cost
        cost = sum(("merge" in r.action) + 2 * ("relabel" in r.action) + 3 * len(r.inserted) for r in turns)
        assert cost == turns[0].conv_cost
        text = "".join(r.rendered for r in turns)
        pieces = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in pieces) == text
        before = ""
        for role, _ in pieces:
            assert role in chat_repair.LEGAL[before]
            before = role
        assert before == "assistant"


def test_legal_conversation_stays(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = chat_repair.repaired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("at").collect()
    assert [r.action for r in got] == ["keep"] * 3 and got[0].conv_cost == 0
    assert "".join(r.rendered for r in got) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_empty_table(spark):
    assert chat_repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
