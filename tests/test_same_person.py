"""Groups of cards against all pairs and union-find."""

import random
from itertools import combinations

from brindle.operators import same_person
from brindle.operators.contacts import CONFIDENCE, SAFE
from brindle.queries import signing
from brindle.queries.all import QUERIES
from brindle.sources.corpus import Corpus

SCHEMA = "id long, given string, additional string, family string, company string, emails array<string>, phones array<struct<value:string,mobile:boolean>>, bare boolean"


def words(s):
    return set((s or "").lower().replace("-", " ").replace(".", " ").split())


def agree(a, b):
    return any(x.startswith(y) or y.startswith(x) for x in a for y in b)


def compatible(a, b):
    (ga, fa, ca), (gb, fb, cb) = [tuple(words(x[k]) for k in ("given", "family", "company")) for x in (a, b)]
    if not (ga or fa) or not (gb or fb):
        firm = [not (g or f) and bool(c) for g, f, c in ((ga, fa, ca), (gb, fb, cb))]
        return ca <= cb or cb <= ca if all(firm) else not any(firm)
    return not (fa and fb and not agree(fa, fb)) and not (ga and gb and not agree(ga, gb))


def keys(c, shared):
    full = lambda *p: " ".join(" ".join(c[k] or "" for k in p).lower().split())
    short, firm = full("given", "family"), full("company")
    out = {("same name", n) for n in (short, full("given", "additional", "family")) if " " in n}
    out |= {("same name and company", f"{short}|{firm}")} if firm else set()
    out |= {("same email", e.lower().strip()) for e in c["emails"] or [] if e.strip() and f"email:{e.lower().strip()}" not in shared}
    for value, mobile in c["phones"] or []:
        d = "".join(x for x in value if x.isdigit())
        if len(d) >= 7 and value.startswith("+") and f"phone:+{d}" not in shared:
            out.add(("same phone" if mobile else "same landline and name", d))
        elif len(d) >= 7 and not value.startswith("+"):
            out.add(("same phone digits", d[-9:]))
    return out


def components(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def plain(cards, rejected, shared):
    have = {c["id"]: keys(c, shared) for c in cards}
    held = {}
    for c in cards:
        for k in have[c["id"]]:
            held.setdefault(k, []).append(c)
    edges = {}
    for a, b in combinations(cards, 2):
        if (a["id"], b["id"]) in rejected or (b["id"], a["id"]) in rejected:
            continue
        for r, k in have[a["id"]] & have[b["id"]]:
            if r.startswith("same name") or compatible(a, b):
                edges.setdefault((a["id"], b["id"]), set()).add(r)
            if r == "same name" and len(held[(r, k)]) == 2 and a["bare"] != b["bare"]:
                edges.setdefault((a["id"], b["id"]), set()).add("same name, one holds nothing else")
    sure = components(p for p, r in edges.items() if r & set(SAFE))
    out, reasons = set(), {}
    for (a, b), rs in edges.items():
        reasons.setdefault(sure.get(a, a), set()).update(rs & set(SAFE)) if rs & set(SAFE) else None
    doubt = {sure[a] for a, b in rejected if a in sure and sure.get(a) == sure.get(b)}
    show = lambda rs: (max(CONFIDENCE[r] for r in rs), ", ".join(sorted(rs)))
    for x, g in sure.items():
        c, text = show(reasons[g])
        out.add((x, g, c, g not in doubt, text))
    weak = {}
    for (a, b), rs in edges.items():
        ga, gb = sure.get(a, a), sure.get(b, b)
        if ga != gb and rs - set(SAFE):
            weak.setdefault((ga, gb), set()).update(rs - set(SAFE))
    joined, why = components(weak), {}
    for (a, _), rs in weak.items():
        why.setdefault(joined[a], set()).update(rs)
    for c in cards:
        top = joined.get(sure.get(c["id"], c["id"]))
        if top is not None:
            out.add((c["id"], top, show(why[top])[0], False, show(why[top])[1]))
    return out


def draw(seed, n):
    r, cards = random.Random(seed), []
    pick = lambda *xs: r.choice(xs)
    for i in range(n):
        bare = r.random() < 0.2
        cards.append({
            "id": i, "given": pick(None, "", "Ann", "A.", "Annabel", "Rob", "robert", "Cy", "Ann Rob"), "additional": pick(None, None, "M", "Dev"),
            "family": pick(None, "", "Lee", "Lee-Roe", "Roe", "Yusof", "Bin Yusof", "L"), "company": None if bare else pick(None, None, "Acme", "Acme North", "north acme", "Best"),
            "emails": [] if bare else r.choices([f"e{k}@x.org" for k in range(n // 3)] + ["E1@X.org", ""], k=r.randrange(3)),
            "phones": None if bare else [(f"{pick('+44 7', '07')}{100000 + r.randrange(n // 3)}", r.random() < 0.6) for _ in range(r.randrange(2))], "bare": bare,
        })
    return cards


def test_groups(spark):
    for seed, n, rejections in ((2, 60, 40), (3, 12, 30)):
        cards, r = draw(seed, n), random.Random(seed)
        rejected = {tuple(r.sample(range(n), 2)) for _ in range(rejections)}
        shared = {"email:e2@x.org", "phone:+447100001"} if seed == 2 else set()
        df = spark.createDataFrame([tuple(c.values()) for c in cards], SCHEMA)
        no, values = spark.createDataFrame(list(rejected), "a long, b long"), spark.createDataFrame([(s,) for s in shared], "value string")
        got = same_person.duplicates(df, no if rejected else None, values if shared else None).collect()
        assert {(x.id, x.component, x.confidence, x.safe, x.reasons) for x in got} == plain(cards, rejected, shared), seed


def test_query(spark):
    data = "/root/testdata/sf0.001"
    c = Corpus(spark, data)
    cards = [r.asDict() for r in signing.book(c).collect()]
    rejected = {(r.a, r.b) for r in signing.rejections(c).collect()}
    shared = {f"email:m{k // 18}@y.org" for k in range(0, len(cards), 40)}
    got = {(x.id, x.component, x.confidence, x.safe, x.reasons) for x in QUERIES["contact_same_person"](spark, data).collect()}
    assert got == plain(cards, rejected, shared)
    assert {x[3] for x in got} == {True, False}
    seen = " ".join(x[4] for x in got)
    assert [r for r in CONFIDENCE if r not in seen] == []
