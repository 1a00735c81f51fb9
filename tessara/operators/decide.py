"""Choices under constraints: Spark prunes candidates, a small exact search on the driver chooses."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Item:
    key: int
    group: str
    team: str
    price: int
    value: float


def undominated(pool: DataFrame, key: str, group: str, team: str, price: str, value: str, quota: dict[str, int], per_team: int) -> list[Item]:
    """The candidates that a best choice can hold.

    An item is left out if enough others of its group are no dearer and no worse; "enough" is the quota plus what the
    team limit may forbid. Spark keeps, of each group and whole-number price, the best few of each team and of all (a
    ranked limit that is applied before the exchange, too); what is collected is at most quota plus squad size for each
    group and price, so it grows with the range of prices but not with the pool. The driver walks prices upwards.
    """
    ranked = pool.where(F.col(value).isNotNull() & F.col(price).isNotNull() & F.col(group).isin(list(quota)))
    need = F.create_map(*[F.lit(x) for g, n in quota.items() for x in (g, n)])
    # keep of every price in a group the best few of each team, then the best few at all
    by_team = Window.partitionBy(group, price, team).orderBy(F.col(value).desc(), key)
    by_price = Window.partitionBy(group, price).orderBy(F.col(value).desc(), key)
    total = sum(quota.values())
    kept = ranked.withColumn("__t", F.row_number().over(by_team)).where(F.col("__t") <= per_team).withColumn("__p", F.row_number().over(by_price)).where(F.col("__p") <= F.element_at(need, F.col(group)) + F.lit(total))
    rows = [Item(r[0], r[1], r[2], int(r[3]), float(r[4])) for r in kept.select(key, group, team, price, value).collect()]
    # prices are few; the rest of the pruning walks them upwards
    out: list[Item] = []
    for name, n in quota.items():
        best: list[Item] = []
        for item in sorted((x for x in rows if x.group == name), key=lambda x: (x.price, -x.value, x.key)):
            better = [b for b in best if b.value >= item.value]
            counted: dict[str, int] = {}
            usable = 0
            for b in better:
                counted[b.team] = counted.get(b.team, 0) + 1
                usable += counted[b.team] <= per_team
            if usable < n + total:
                best.append(item)
        out += best
    return out


def best_squad(items: list[Item], quota: dict[str, int], budget: int, per_team: int, limit: int | None = None) -> list[Item]:
    """The items of greatest total value within quotas, budget and team limit: branch and bound.

    One bound prices the budget (Lagrange multiplier found by bisection) and forgets the team limit, another forgets
    both. The search runs to its end; with a ``limit`` of nodes it raises beyond it, as what it found may not be best.
    [] if there is no choice at all.
    """
    def relaxed(lam: float) -> tuple[float, int]:
        total, cost = 0.0, 0
        for group, n in quota.items():
            best = sorted((x for x in items if x.group == group), key=lambda x: lam * x.price - x.value)[:n]
            total += sum(x.value - lam * x.price for x in best)
            cost += sum(x.price for x in best)
        return total, cost

    low, high = 0.0, max([x.value for x in items], default=0.0) + 1.0
    for _ in range(50):
        lam = (low + high) / 2
        low, high = (lam, high) if relaxed(lam)[1] > budget else (low, lam)
    lam = high
    order = {g: sorted((x for x in items if x.group == g), key=lambda x: (lam * x.price - x.value, x.key)) for g in quota}
    groups = sorted(quota, key=lambda g: len(order[g]))
    worth = {g: [x.value - lam * x.price for x in order[g]] for g in groups}
    tail = {g: sum(sum(worth[h][: quota[h]]) for h in groups[k + 1 :]) for k, g in enumerate(groups)}
    # the greatest values from each place on, summed up to the quota
    richest = {g: [[0.0, *accumulate(sorted((x.value for x in order[g][k:]), reverse=True)[: quota[g]])] for k in range(len(order[g]))] for g in groups}
    rich_tail = {g: sum(richest[h][0][-1] for h in groups[k + 1 :] if order[h]) for k, g in enumerate(groups)}
    cheapest = {g: sum(sum(sorted(x.price for x in order[h])[: quota[h]]) for h in groups[k + 1 :]) for k, g in enumerate(groups)}
    if any(len(order[g]) < quota[g] for g in groups):
        return []
    best: tuple[float, list[Item]] = (float("-inf"), [])
    nodes = 0

    def walk(at: int, start: int, left: int, chosen: list[Item], value: float, cost: int, teams: dict[str, int]) -> None:
        nonlocal best, nodes
        nodes += 1
        if limit is not None and nodes > limit:
            raise RuntimeError(f"no choice is proven best within {limit} nodes")
        if at == len(groups):
            if value > best[0] + 1e-12:
                best = (value, list(chosen))
            return
        g = groups[at]
        if left == 0:
            nxt = at + 1
            walk(nxt, 0, quota[groups[nxt]] if nxt < len(groups) else 0, chosen, value, cost, teams)
            return
        for k in range(start, len(order[g]) - left + 1):
            bound = value - lam * cost + lam * budget + sum(worth[g][k : k + left]) + tail[g]
            if min(bound, value + richest[g][k][left] + rich_tail[g]) <= best[0] + 1e-12:
                return
            x = order[g][k]
            if cost + x.price + cheapest[g] > budget or teams.get(x.team, 0) >= per_team:
                continue
            teams[x.team] = teams.get(x.team, 0) + 1
            chosen.append(x)
            walk(at, k + 1, left - 1, chosen, value + x.value, cost + x.price, teams)
            chosen.pop()
            teams[x.team] -= 1

    walk(0, 0, quota[groups[0]], [], 0.0, 0, {})
    return best[1]


def starting(squad: list[Item], least: dict[str, int], most: dict[str, int], n: int = 11) -> list[Item]:
    """The ``n`` of greatest value with at least and at most so many of each group; [] if that can't be.

    First the best of each group up to its least number, then the best of all others whose group has room: as bounds of
    groups form a matroid, no other choice is better.
    """
    order = sorted(squad, key=lambda x: (-x.value, x.key))
    chosen = [x for g, k in least.items() for x in [y for y in order if y.group == g][:k]]
    held = {g: sum(x.group == g for x in chosen) for g in most}
    if len(chosen) > n or any(held.get(g, 0) < k for g, k in least.items()):
        return []
    taken = {x.key for x in chosen}
    for x in order:
        if len(chosen) == n:
            break
        if x.key not in taken and held.get(x.group, 0) < most.get(x.group, 0):
            chosen.append(x)
            held[x.group] += 1
    return sorted(chosen, key=lambda x: (-x.value, x.key)) if len(chosen) == n else []


def captains(pool: DataFrame, by: str, key: str, value: str, ceiling: str) -> DataFrame:
    """(by, captain, vice, high): best and second by value and best by ceiling, of each group."""
    first = F.struct((-F.col(value)).alias("a"), F.col(key).alias("b"))
    best = pool.groupBy(by).agg(F.min(first).alias("c"), F.max_by(key, F.struct(F.col(ceiling), -F.col(key))).alias("high"))
    rest = pool.join(best.select(by, F.col("c.b").alias("__c")), by).where(F.col(key) != F.col("__c")).groupBy(by).agg(F.min(first).alias("v"))
    return best.join(rest, by, "left").select(by, F.col("c.b").alias("captain"), F.col("v.b").alias("vice"), "high")


def plan_swaps(rounds: list[int], owned: list[Item], offers: dict[int, list[Item]], scores: dict[int, dict[int, float]], bank: int, per_team: int, window: int = 3, least_gain: float = 1.0, most_free: int = 5) -> list[tuple[int, int, int, float]]:
    """(round, out, in, gain): at each round the best single swap over the next ``window`` rounds, if it gains enough.

    A bounded driver loop over a squad of fixed size; unused swaps are banked up to ``most_free``.
    """
    squad, free, plan = {x.key: x for x in owned}, 1, []
    for r in rounds:
        ahead = lambda key: sum(scores.get(t, {}).get(key, 0.0) for t in range(r, r + window))  # noqa: E731, B023
        teams: dict[str, int] = {}
        for x in squad.values():
            teams[x.team] = teams.get(x.team, 0) + 1
        best = None
        for x in squad.values():
            for y in offers.get(r, []):
                if y.key in squad or y.group != x.group or y.price > x.price + bank or teams.get(y.team, 0) - (x.team == y.team) >= per_team:
                    continue
                gain = ahead(y.key) - ahead(x.key)
                if gain >= least_gain and (best is None or (gain, -y.key) > (best[0], -best[2].key)):
                    best = (gain, x, y)
        if best and free:
            gain, x, y = best
            del squad[x.key]
            squad[y.key] = y
            bank += x.price - y.price
            plan.append((r, x.key, y.key, gain))
            free -= 1
        free = min(most_free, free + 1)
    return plan
