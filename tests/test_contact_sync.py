"""Syncs of cards: any split into pages, any replay and a run that breaks off give what one plain merge gives."""

import random
import tempfile

import pytest

from brindle.operators.contact_sync import PAGE, ContactSync

CARDS, SEEN = "id long, field string, value string, edited_ms long", "id long, field string, value string"
FIELDS = ("name", "mail", "note")


def plain(base, own, states, changes):
    """The rule card by card: base and own are {(id, field): value} and {(id, field): (value, ms)}."""
    last = {}
    for c in changes:
        if c[0] is not None and (c[0] not in last or c[1] > last[c[0]][1]):
            last[c[0]] = c
    for i, _, fields, ms, gone in last.values():
        if gone:
            if states.get(i) == "synced":
                states[i] = "deleted_remote"
                for k in [k for k in base if k[0] == i]:
                    del base[k]
            continue
        states[i] = "synced"
        for f in {k[1] for k in own | base if k[0] == i} | set(fields or {}):
            b, (value, at), r = base.pop((i, f), None), own.get((i, f), (None, -1)), (fields or {}).get(f)
            if not (r == b or value == r) and (value == b or ms >= at):
                own[i, f] = (r, ms)
            if own.get((i, f), (None, 0))[0] is None and r is None:
                own.pop((i, f), None)
            if r is not None:
                base[i, f] = r
    return base, own, states


def pages(spark, changes, sizes):
    """A provider that cuts changes at given places, and the tokens that were asked for."""
    asked = []

    def provider(token):
        k = int((token or "0").split("/")[0])
        asked.append(k)
        part = changes[sizes[k - 1] if k else 0 : sizes[k] if k < len(sizes) else None]
        return spark.createDataFrame(part, PAGE), "0/next" if k == len(sizes) else str(k + 1), k == len(sizes)

    return provider, asked


def found(sync):
    rows = lambda name, *c: sorted(tuple(r[x] for x in c) for r in sync.rows(name).collect())
    return rows("base", "id", "field", "value"), [x for x in rows("states", "id", "state")], sorted((r["id"], r["field"], r["value"] or "", r["edited_ms"]) for r in sync.rows("fields").collect())


@pytest.mark.parametrize("seed", [3, 8])
def test_any_split_and_replay(spark, seed):
    r = random.Random(seed)
    base = {(i, f): f"{f}{i}" for i in range(12) for f in FIELDS if r.random() < 0.8}
    own = {k: (r.choice([v, v, v + "!", None]), r.randrange(10)) for k, v in base.items()} | {(50, "name"): ("mine alone", 3)}
    states = {i: "synced" for i, _ in base}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    sync = ContactSync(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), make([(*k, *v) for k, v in own.items()], CARDS), make([(*k, v) for k, v in base.items()], SEEN))
    for run in range(2):
        changes = [(r.choice([*range(15), None]), n, {f: r.choice([f"{f}{n % 4}", f"x{n}"]) for f in FIELDS if r.random() < 0.7}, r.randrange(10), r.random() < 0.2) for n in range(30)]
        r.shuffle(changes)
        sizes = sorted(r.sample(range(31), 3))
        provider, asked = pages(spark, changes, sizes)
        if run == 0:  # breaks off at the third page, and is taken up by another process
            def broken(token):
                if (token or "").startswith("2"):
                    raise OSError
                return provider(token)

            with pytest.raises(OSError):
                sync.pull(broken)
            with pytest.raises(ValueError):
                sync.finish()
            sync = ContactSync(spark, sync.folder)
            sync.stage(*(lambda p: (p[0], "1", *p[1:]))(provider("1")))  # a page comes again
        sync.pull(provider)
        assert asked == ([0, 1, 1, 2, 3] if run == 0 else [0, 1, 2, 3])
        before = found(sync)
        assert before == found(ContactSync(spark, sync.folder)) and sync.position()[0] == run
        assert sync.finish(allow=True) and sync.position() == (run + 1, "0/next")
        plain(base, own, states, changes)
        right = sorted((*k, v) for k, v in base.items()), sorted(states.items()), sorted((*k, v[0] or "", v[1]) for k, v in own.items())
        assert found(sync) == right
        if run == 0:
            key = min(k for k in own if states.get(k[0]) == "synced")
            own[key] = ("edited here", 99)
            sync.edit(make([(*key, "edited here", 99)], CARDS))
            assert (*key, "edited here") in {tuple(x) for x in sync.to_send().collect()}
    sync.compact()
    assert found(sync) == right


def test_many_deletes_wait(spark):
    cards = spark.createDataFrame([(i, "name", f"n{i}", 0) for i in range(20)], CARDS)
    make = lambda: ContactSync(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), cards, cards.drop("edited_ms"))
    some = spark.createDataFrame([(i, 1, {"name": f"n{i}"}, 5, None) for i in range(10)], PAGE)
    sync = make()
    sync.pull(lambda token: (some, "t", True))
    assert not sync.finish(full=True, master=True) and sync.rows("fields").count() == 20 and sync.position() == (0, None)
    assert sync.finish(full=True, master=True, allow=True)
    assert sorted(x["id"] for x in sync.rows("fields").collect()) == list(range(10)) == sorted(x["id"] for x in sync.rows("states").collect())
    empty = ContactSync(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    empty.pull(lambda token: (spark.createDataFrame([(1, 1, None, None, None), (None, 2, {"a": "b"}, 1, False)], PAGE), None, True))
    assert empty.finish() and empty.rows("fields").count() == 0 and [tuple(x) for x in empty.rows("states").collect()] == [(1, "synced")]
