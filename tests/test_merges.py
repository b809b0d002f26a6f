"""Merges applied and undone in waves, against doing them one by one."""

import random

from comanda.operators import merges
from comanda.operators.merges import Book

PEOPLE = 14


def start(spark):
    r = random.Random(3)
    customers = [(i, f"p{i}" if r.random() < 0.4 else None, f"a{i}" if r.random() < 0.4 else None, r.random() < 0.3) for i in range(PEOPLE)]
    orders = [(100 + k, r.randrange(PEOPLE)) for k in range(40)]
    addresses = [(k, r.randrange(PEOPLE), f"House {r.randrange(3)}", None if k % 2 else "Flat", "X", k % 3 == 0) for k in range(20)]
    frames = spark.createDataFrame(customers, "customer_id bigint, phone string, address string, is_verified boolean"), spark.createDataFrame(orders, "order_id bigint, customer_id bigint"), spark.createDataFrame(addresses, "address_id bigint, customer_id bigint, address_line_1 string, address_line_2 string, city string, is_default boolean")
    return Book.new(*frames), customers, orders, addresses


class OneByOne:
    def __init__(self, customers, orders, addresses):
        self.c = {i: [p, a, v] for i, p, a, v in customers}
        self.o = dict(orders)
        self.a = [{"id": i, "by": None, "of": c, "line": "|".join(x.strip().lower() for x in (l1, l2, city) if x is not None), "default": d} for i, c, l1, l2, city, d in addresses]
        self.history = {}

    def apply(self, m, s, t, mark):
        if s == t or s not in self.c or t not in self.c or (self.c[s][2] and not self.c[t][2]):
            return
        before = list(self.c[t])
        for k in (0, 1):
            self.c[t][k] = self.c[t][k] if self.c[t][k] is not None else self.c[s][k]
        self.c[t][2] = self.c[t][2] or (mark and not self.c[s][2])
        moved = [o for o, c in self.o.items() if c == s]
        self.o.update(dict.fromkeys(moved, t))
        for a in sorted((a for a in self.a if a["of"] == s), key=lambda a: (not a["default"], a["id"])):
            mine = [b for b in self.a if b["of"] == t]
            if a["line"] not in {b["line"] for b in mine}:
                self.a.append({**a, "by": m, "of": t, "default": a["default"] and not any(b["default"] for b in mine)})
        self.history[m] = (s, t, before, moved)

    def undo(self, m):
        if m not in self.history:
            return
        s, t, before, moved = self.history.pop(m)
        self.o.update({o: s for o in moved if self.o[o] == t})
        self.a = [a for a in self.a if not (a["by"] == m and a["of"] == t)]
        self.c[t] = list(before)

    def state(self):
        return {i: tuple(v) for i, v in self.c.items()}, dict(self.o), {(a["id"], a["by"] or -1, a["of"], a["default"]) for a in self.a}


def state(book):
    return (
        {r.customer_id: (r.phone, r.address, r.is_verified) for r in book.customers.collect()}, {r.order_id: r.customer_id for r in book.orders.collect()},
        {(r.address_id, -1 if r.copied_by is None else r.copied_by, r.customer_id, r.is_default) for r in book.addresses.collect()},
    )


def in_waves(spark, book, step, rows, schema, final):
    left, statuses = rows, {}
    while left:
        book, status = step(book, spark.createDataFrame(left, schema))
        book = book.written()
        statuses |= {r.merge_id: r.status for r in status.collect()}
        nxt = [x for x in left if statuses[x[0]] == "later"]
        assert len(nxt) < len(left)
        left = nxt
    assert final in statuses.values()
    return book, statuses


def test_waves_equal_one_by_one(spark):
    book, *tables = start(spark)
    plain, first = OneByOne(*tables), state(book)
    r = random.Random(5)
    sources = r.sample(range(PEOPLE), 9)
    todo = [(k + 1, s, r.randrange(PEOPLE // 2), r.random() < 0.5) for k, s in enumerate(sources)] + [(50, 3, 3, True), (51, 99, 1, True), (52, 2, 0, None)]
    book, statuses = in_waves(spark, book, merges.apply, todo, "merge_id bigint, source bigint, target bigint, mark_verified boolean", "applied")
    for x in todo:
        plain.apply(*x)
    assert state(book) == plain.state() and statuses[50] == statuses[51] == "refused"
    assert {m for m, s in statuses.items() if s == "applied"} == set(plain.history) and "refused" in statuses.values()
    shown = {r.merge_id: r for r in merges.contexts(book).collect()}
    assert {m: (r.source, r.target, [r.before_phone, r.before_address, r.before_verified], r.orders_moved) for m, r in shown.items()} == {m: (s, t, b, len(moved)) for m, (s, t, b, moved) in plain.history.items()}
    some = sorted(plain.history)[::2]
    part, _ = in_waves(spark, book, merges.undo, [(m,) for m in (*some, 77)], "merge_id bigint", "undone")
    rest = sorted(plain.history)
    for m in reversed(some):
        plain.undo(m)
    assert state(part) == plain.state()
    whole, statuses = in_waves(spark, book, merges.undo, [(m,) for m in rest], "merge_id bigint", "undone")
    assert state(whole) == first and set(statuses.values()) == {"undone"}
    assert merges.undo(whole, spark.createDataFrame([(rest[0],)], "merge_id bigint"))[1].first().status == "refused"
