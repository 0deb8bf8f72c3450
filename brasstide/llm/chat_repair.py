"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering.

Cost and choice of each turn depend on the turns before only through the role rendered last, so a
stretch of turns is a 4 x 4 table of least costs, and tables of neighbouring stretches combine by
(min, +). Conversations are cut in blocks; long ones need no task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from brasstide.llm.common import regrouped, written

ROLES = ("", "system", "user", "assistant")  # the first stands for the start
#: Roles that may follow each role; a conversation must end after the last one, or be empty.
LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
END = "assistant"
BLOCK_BITS = 11  # blocks of at most 2048 turns
INFINITE = 1e18


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 3.0


def _way(a: int, b: int) -> tuple[int, ...] | None:
    """Shortest legal way from role a to role b, without a: the roles to insert, then b."""
    seen, front = {a}, [(a, ())]
    while front:
        later = []
        for at, way in front:
            for name in LEGAL[ROLES[at]]:
                to = ROLES.index(name)
                if to == b:
                    return (*way, to)
                if to not in seen:
                    seen.add(to)
                    later.append((to, (*way, to)))
        front = later
    return None


def _moves(costs: Costs) -> list[list[list[tuple[float, bool, tuple[int, ...]]]]]:
    """[role of the turn][role before][role after] -> (cost, merged, inserted roles)."""
    table = []
    for own in range(len(ROLES)):  # 0: an unknown role
        rows = []
        for a in range(len(ROLES)):
            row = [(INFINITE, False, ())]
            for b in range(1, len(ROLES)):
                label = 0.0 if own == b else costs.relabel
                ways = [(costs.merge + label, True, ())] if a == b else []
                way = _way(a, b)
                if way is not None:
                    ways.append((costs.insert * (len(way) - 1) + label, False, way[:-1]))
                row.append(min(ways, default=(INFINITE, False, ()), key=lambda w: (w[0], len(w[2]), w[1])))
            rows.append(row)
        table.append(rows)
    return table


def _closing(costs: Costs) -> list[tuple[float, tuple[int, ...]]]:
    """[last role] -> (cost, inserted roles) of coming to a legal end."""
    end = ROLES.index(END)
    out = [(0.0, ())]
    for a in range(1, len(ROLES)):
        way = () if a == end else _way(a, end)
        out.append((costs.insert * len(way), way))
    return out


def _role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def _same(keys: tuple[str, ...]):
    """Row i is of the group of row i - 1, nulls included."""
    def same(table):
        import numpy as np
        out = np.ones(table.num_rows, dtype=bool)
        out[0] = False
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode()
            index = codes.indices if hasattr(codes, "indices") else codes.combine_chunks().indices
            ids = index.fill_null(-1).to_numpy(zero_copy_only=False)
            out[1:] &= ids[1:] == ids[:-1]
        return out
    return same


def _tables(costs: Costs):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        steps = np.array([[[w[0] for w in row] for row in rows] for rows in _moves(costs)])
        same = _same(("conv_id", "block"))
        for piece in regrouped(batches, same, 20_000):
            starts = np.flatnonzero(~same(piece))
            roles = [_role_of(r) for r in piece.column("role").to_pylist()]
            ends = np.append(starts[1:], len(roles)).tolist()
            tables = []
            for a, b in zip(starts.tolist(), ends):
                m = steps[roles[a]]
                for r in roles[a + 1:b]:
                    m = (m[:, :, None] + steps[r][None]).min(axis=1)
                tables.append(np.minimum(m, INFINITE).ravel().tolist())
            first = piece.take(pa.array(starts))
            yield from pa.table({"conv_id": first.column("conv_id"), "block": first.column("block"), "m": pa.array(tables, pa.list_(pa.float64()))}).to_batches()
    return run


def _routes(costs: Costs):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        close = [c for c, _ in _closing(costs)]
        same = _same(("conv_id",))
        for piece in regrouped(batches, same, 5_000):
            starts = np.flatnonzero(~same(piece)).tolist()
            tables = np.array(piece.column("m").to_pylist()).reshape(-1, 4, 4)
            entry, leave, cost, last = [], [], [], []
            for a, b in zip(starts, [*starts[1:], piece.num_rows]):
                reach = [np.array([0.0, INFINITE, INFINITE, INFINITE])]
                for m in tables[a:b]:
                    reach.append((reach[-1][:, None] + m).min(axis=0))
                at = int(np.argmin(reach[-1] + close))
                total = float(reach[-1][at] + close[at])
                way = [at]
                for k in range(b - a - 1, -1, -1):
                    way.append(int(np.argmin(reach[k] + tables[a + k][:, way[-1]])))
                way.reverse()
                entry += way[:-1]
                leave += way[1:]
                cost += [total] * (b - a)
                last += [False] * (b - a - 1) + [True]
            yield from pa.table({"conv_id": piece.column("conv_id"), "block": piece.column("block"), "entry": pa.array(entry, pa.int32()),
                                 "leave": pa.array(leave, pa.int32()), "conv_cost": pa.array(cost, pa.float64()), "last": pa.array(last)}).to_batches()
    return run


def _plain(text: str | None) -> str:
    """A text that can't be read as a turn's mark."""
    return (text or "").replace("<|", "< |")


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_CLOSE = "<|im_end|>\n"


def _renderer(costs: Costs):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        moves, closing = _moves(costs), _closing(costs)
        same = _same(("conv_id", "block"))
        for piece in regrouped(batches, same, 5_000):
            starts = np.flatnonzero(~same(piece)).tolist()
            roles = [_role_of(r) for r in piece.column("role").to_pylist()]
            texts = piece.column("text").to_pylist()
            entries, leaves, lasts = (piece.column(c).to_pylist() for c in ("entry", "leave", "last"))
            new_role, action, inserted, rendered = [], [], [], []
            for a, b in zip(starts, [*starts[1:], piece.num_rows]):
                reach = [[INFINITE] * 4]
                reach[0][entries[a]] = 0.0
                for r in roles[a:b]:
                    before, step = reach[-1], moves[r]
                    reach.append([min(before[s] + step[s][t][0] for s in range(4)) for t in range(4)])
                way = [leaves[a]]
                for k in range(b - a - 1, -1, -1):
                    before, step = reach[k], moves[roles[a + k]]
                    way.append(min(range(4), key=lambda s: before[s] + step[s][way[-1]][0]))
                way.reverse()
                for k in range(b - a):
                    s, t, own = way[k], way[k + 1], roles[a + k]
                    _, merged, extra = moves[own][s][t]
                    if merged:
                        out = "\n" + _plain(texts[a + k])
                    else:
                        out = (_CLOSE if s else "") + "".join(_open(x) + _CLOSE for x in extra) + _open(t) + _plain(texts[a + k])
                    after = ()
                    if lasts[a] and k == b - a - 1:
                        after = closing[t][1]
                        out += _CLOSE + "".join(_open(x) + _CLOSE for x in after)
                    new_role.append(ROLES[t])
                    action.append(("merge" if merged else "keep") + ("+relabel" if own != t else ""))
                    inserted.append([*(ROLES[x] for x in extra), *(f"end:{ROLES[x]}" for x in after)])
                    rendered.append(out)
            cols = {c: piece.column(c) for c in ("conv_id", "turn", "at", "role")}
            cols |= {"new_role": pa.array(new_role, pa.string()), "action": pa.array(action, pa.string()),
                     "inserted": pa.array(inserted, pa.list_(pa.string())), "rendered": pa.array(rendered, pa.string()),
                     "conv_cost": piece.column("conv_cost")}
            yield from pa.table(cols).to_batches()
    return run


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", costs: Costs = Costs()) -> DataFrame:
    """(conv_id, turn, at, role, new_role, action, inserted, rendered, conv_cost): one row per turn.

    Each turn keeps its role, is relabelled, or merges into the turn before; empty turns may be
    inserted before it (and, marked `end:`, after the last). The choices cost least over the whole
    conversation (`conv_cost`). The `rendered` pieces in order of `at`, joined, are the conversation
    in marked-up form. Turns are ordered by turn number (nulls first), then role and text; repeated
    rows are turns of their own. A null or unknown role is relabelled, a null text is empty, rows
    without conv_id form one conversation, an empty table gives no rows.
    """
    kinds = {c: turns.schema[n].dataType.simpleString() for c, n in (("conv_id", conv), ("turn", turn))}
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .withColumn("at", F.monotonically_increasing_id())
                      .withColumn("block", F.shiftright("at", BLOCK_BITS)), "turns")
    key = f"conv_id {kinds['conv_id']}"
    tables = (ordered.select("conv_id", "block", "at", "role").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
              .select("conv_id", "block", "role").mapInArrow(_tables(costs), f"{key}, block bigint, m array<double>"))
    # a conversation's tables meet in one task: one row per 2048 turns
    routes = (tables.repartition("conv_id").sortWithinPartitions("conv_id", "block")
              .mapInArrow(_routes(costs), f"{key}, block bigint, entry int, leave int, conv_cost double, last boolean"))
    routes = routes.withColumnsRenamed({"conv_id": "route_conv", "block": "route_block"})
    both = ordered.join(routes, ordered.conv_id.eqNullSafe(routes.route_conv) & (ordered.block == routes.route_block)).drop("route_conv", "route_block")
    spread = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return spread.mapInArrow(_renderer(costs), f"{key}, turn {kinds['turn']}, at bigint, role string, new_role string, "
                                               "action string, inserted array<string>, rendered string, conv_cost double")
