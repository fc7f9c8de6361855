"""A plain model of the adaptive sieve for small shards: lists and dicts, every rule written out where it applies."""

from tidemark.functions.hashing import avalanche_int
from tidemark.operators.sketch import Doorkeeper, Ghosts, Sketch


def isqrt(n):
    r = 0
    while (r + 1) * (r + 1) <= n:
        r += 1
    return max(1, r)


class PlainSieve:
    def __init__(self, cap, budget=0, probation=1, ghosts=75, admission="frequency"):
        self.cap, self.budget, self.admission = cap, budget, admission
        self.small = max(1, cap // 100)
        self.large = max(self.small, cap * 60 // 100)
        if self.large >= cap > 1:
            self.large = cap - 1
        self.share = min(max(cap * probation // 100, self.small), self.large)
        b1 = (cap - self.share) * ghosts // 100
        self.b1, self.b2 = Ghosts(max(1, b1) if cap > self.share else max(0, b1)), Ghosts(cap)
        self.sketch, self.door = Sketch(max(10 * cap, 1024)), Doorkeeper(max(10 * cap, 1024))
        self.log, self.n, self.cycles = [], 0, []
        self.start()

    def start(self):
        self.e, self.young, self.main, self.hand = {}, [], [], None  # lists run from the oldest on
        self.state, self.evidence, self.base, self.low, self.wait, self.back = "recency", 0.0, 0.0, 0.0, 0, 3
        self.twice = True
        self.totals = dict.fromkeys(("admits", "rejects", "ghost_hits", "promotions", "probation_evictions", "main_evictions"), 0)
        self.new_cycle()

    def new_cycle(self):
        names = ("observed", "ghost_hits", "probation_drops", "promotions", "survivals", "evictions", "rejects", "main_evictions", "returns")
        self.c = dict.fromkeys(names, 0)

    def clear(self):
        for x in (self.b1, self.b2, self.sketch, self.door):
            x.clear()
        self.start()

    def cost(self):
        return sum(x["cost"] for x in self.e.values())

    def full(self):
        return len(self.e) > self.cap or (self.budget and self.cost() > self.budget)

    def cold(self):
        return len(self.e) < self.cap / 2

    def next(self, k):
        return None if len(self.main) < 2 else self.main[(self.main.index(k) + 1) % len(self.main)]

    def remove(self, k, why):
        if self.hand == k:
            self.hand = self.next(k)
        (self.young if k in self.young else self.main).remove(k)
        del self.e[k]
        self.log.append((self.n, why, k))

    def observe(self):
        self.sketch.samples += 1
        if self.sketch.samples >= self.sketch.reset_at:
            self.sketch.age()
            self.door.clear()
        self.c["observed"] += 1
        if self.c["observed"] >= max(4 * self.cap, 8192 if self.cap >= 1024 else 0):
            self.end_cycle()

    def deposit(self, h):
        if self.door.add(avalanche_int(h)):
            self.sketch.add(avalanche_int(h))
        self.observe()

    def uses(self, h):
        return min(15, self.sketch.estimate(avalanche_int(h)) + (avalanche_int(h) in self.door))

    def end_cycle(self):
        c = self.c
        self.cycles.append((self.n, *c.values(), self.share, int(self.state != "recency")))
        churn = float(c["evictions"] + c["rejects"])
        returning = c["returns"] / c["main_evictions"] if c["main_evictions"] else 0.0
        if self.state == "recency":
            self.base = churn if self.base == 0 else 0.5 * self.base + 0.5 * churn
            if self.wait > 0:
                self.wait -= 1
            elif returning < 0.5:
                self.evidence = 0.0
            else:
                self.evidence += returning
                if self.evidence >= 1:
                    self.state, self.evidence = "trial", 0.0
        elif self.state == "trial" and churn < 0.9 * self.base:
            self.state, self.low, self.back = "frequency", churn, 3
        elif self.state == "frequency" and churn <= 1.5 * self.low and churn <= 0.9 * self.base:
            self.low = churn if self.low == 0 else 0.5 * self.low + 0.5 * churn
        else:
            self.state, self.evidence, self.wait, self.back = "recency", 0.0, self.back, min(96, self.back * 2)
        loop = self.state != "recency" or self.evidence > 0
        if loop:
            self.twice = False
        step = 0
        if not loop and returning < 0.1 and c["main_evictions"] > c["promotions"] and c["ghost_hits"] > c["promotions"]:
            self.twice, step = True, max(1, self.cap // 10)
        elif not loop and returning < 0.1 and c["ghost_hits"] > c["probation_drops"] // 4:
            self.twice, step = True, max(1, self.cap // 100)
        elif c["probation_drops"] > 2 * c["promotions"] and c["survivals"] > c["promotions"]:
            self.twice, step = False, -max(1, self.cap // 100)
        self.share = min(max(self.share + step, self.small), self.large)
        self.new_cycle()

    def get(self, k, now):
        if k not in self.e:
            return False
        x, warm = self.e[k], not self.cold()
        if warm:
            x["visited"] = True
        if 0 < x["deadline"] < now:
            self.remove(k, "expired")
            return False
        if warm:
            self.deposit(x["hash"])
        return True

    def set(self, k, h, cost, deadline):
        if cost < 0 or (self.budget and cost > self.budget):
            return
        if k in self.e:
            x, warm = self.e[k], not self.cold()
            x["cost"], x["deadline"] = cost, deadline
            if warm and k in self.young and self.cap > self.share:
                self.promote(k)
            elif warm:
                x["visited"], x["reuse"] = True, min(3, x["reuse"] + 1)
            if self.full():
                self.enforce(None, False)
            return
        warm = not self.cold()
        ghost = warm and h in self.b1
        if warm:
            self.deposit(h)
            self.deposit(h) if self.twice else self.observe()
        self.e[k] = {"hash": h, "cost": cost, "deadline": deadline, "visited": False, "reuse": 0}
        if self.b2.remove(h):
            self.c["returns"] += 1
        if ghost and self.cap > self.share:
            self.b1.remove(h)
            self.c["ghost_hits"] += 1
            self.totals["ghost_hits"] += 1
            self.enter_main(k)
        else:
            self.young.append(k)
        if warm or self.full():
            self.enforce(k, ghost)
        self.totals["admits" if k in self.e else "rejects"] += 1

    def enter_main(self, k):
        self.e[k]["reuse"], self.e[k]["visited"] = 1, True
        self.main.append(k)
        if self.hand is None:
            self.hand = k

    def promote(self, k):
        self.young.remove(k)
        self.enter_main(k)
        self.c["promotions"] += 1
        self.totals["promotions"] += 1

    def probation_turn(self, new, proven):
        k = self.young[0]
        if self.e[k]["reuse"] or self.e[k]["visited"]:
            if self.cap > self.share:
                self.promote(k)
            return k, True
        self.drop_young(k)
        return new, proven

    def drop_young(self, k):
        h = self.e[k]["hash"]
        self.remove(k, "capacity")
        self.b1.add(h)
        self.c["probation_drops"] += 1
        self.c["evictions"] += 1
        self.totals["probation_evictions"] += 1

    def victim(self, tries, force):
        if not self.main:
            return None
        k = self.main[0] if self.hand is None else self.hand
        for _ in range(tries):
            if not self.e[k]["visited"]:
                self.hand = self.next(k)
                return k
            self.e[k]["visited"], self.e[k]["reuse"] = False, max(0, self.e[k]["reuse"] - 1)
            self.c["survivals"] += 1
            k = k if self.next(k) is None else self.next(k)
        self.hand = self.next(k) if force else k
        if len(self.main) == 1:
            self.hand = None
        return k if force else None

    def better(self, k, v, proven):
        a, b = self.e[k], self.e[v]

        def score(n, cost):
            cost = max(1, cost)
            return {"frequency": n, "balanced": n * isqrt(cost), "density": n * cost}[self.admission]

        own, bar = score(self.uses(a["hash"]), b["cost"]), score(self.uses(b["hash"]), a["cost"])
        if own != bar and (self.state != "recency" or own > bar):
            return own > bar
        if self.state != "recency":
            return False
        if proven:
            return not b["visited"] or own == bar or score(self.uses(a["hash"]) + 1, b["cost"]) >= bar
        return own == bar and not b["visited"] and b["reuse"] == 0

    def main_turn(self, new, proven, force):
        """Whether one of the two went."""
        rival = new if new in self.e else None
        v = self.victim(8, force)
        if v is None and not (force and rival is not None):
            return False
        if rival is not None and (v is None or (v != rival and not self.better(rival, v, proven))):
            self.c["rejects"] += 1
            self.remove(rival, "rejected")
            return True
        h = self.e[v]["hash"]
        self.remove(v, "capacity")
        self.b2.add(h)
        for x in ("evictions", "main_evictions"):
            self.c[x] += 1
        self.totals["main_evictions"] += 1
        return True

    def enforce(self, new, proven):
        for _ in range(32):
            if not self.full() or not self.e:
                return
            if len(self.young) > self.share or not self.main:
                new, proven = self.probation_turn(new, proven)
                continue
            returning = self.c["returns"] / self.c["main_evictions"] if self.c["main_evictions"] else 0.0
            free = self.admission == "frequency" and not self.budget and self.state == "recency" and not self.evidence and returning < 0.1
            if self.main_turn(None if new in self.young and free else new, proven, False):
                new, proven = None, False
        if not self.full():
            return
        if self.young:
            new, proven = self.probation_turn(new, proven)
        if self.main and (len(self.main) > self.cap - self.share or self.full()):
            self.main_turn(new, proven, True)
        while self.full() and self.e:
            if self.young:
                self.drop_young(self.young[0])
            else:
                self.remove(self.victim(1, True), "capacity")
                self.c["evictions"] += 1
                self.totals["main_evictions"] += 1
