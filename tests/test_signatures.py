"""Tails, details and consensus of signatures: by hand, and against a plain version on drawn readings."""

import random
import time

from brindle.operators import signatures as S

SCHEMA = "message long, person string, name string, sent_at long, text string"
MAIL = "Thursday works.\nBest regards,\nAnn  Lee\nSenior engineer | Acme Widgets GmbH\nTel: +49 30 1234567\nT 030 7654321\nM: +49 171 2345678\nANN@acme.de\nwww.Acme.de/\n" + "This text is meant for its reader. " * 4 + "\nDirector"
CITED = "Yes.\n-----Original Message-----\nFrom: \tBob Roe <Bob@x.org>\nSent: 2024-03-05 09:30\n\nHello\n-- \nBob Roe\nNurses\nOn Monday X wrote:\n> Clerk\n---- Original Message ----\nFrom: nobody\n\n-- \nClerk"


def test_details(spark):
    df = spark.createDataFrame([(1, "ann@acme.de", "ann lee", 10, MAIL), (2, "c@x.org", "C", None, CITED), (3, "d@x.org", None, 1, None), (4, "d@x.org", None, 1, "")], SCHEMA)
    blocks = S.blocks(df)
    rows = {(r.message, r.person, r.slot): (r.value, r.name_line, r.quoted, r.sent_at) for r in S.said(blocks).collect()}
    ann = {k[2]: v[0] for k, v in rows.items() if k[0] == 1}
    assert ann == {
        "title": "Senior engineer", "company": "Acme Widgets GmbH", "phone:work": "+49 30 1234567", "phone:work:2": "030 7654321",
        "phone:mobile": "+49 171 2345678", "email:ann@acme.de": "ann@acme.de", "website": "www.Acme.de/",
    }
    assert rows[(2, "bob@x.org", "title")] == ("Nurses", True, True, 1709631000)
    assert {k[1] for k in rows if k[0] == 2} == {"bob@x.org"}
    tails = {r.message: (r.reason, r.tail[:5]) for r in S.tails(df).collect()}
    assert tails == {1: ("signature", "Best "), 2: ("quote", "-----"), 3: ("", ""), 4: ("", "")}
    kept = S.keep_tails(S.tails(df).filter("tail != ''"), spark.createDataFrame([(1, "", ""), (5, "> a", "quote")], "message long, tail string, reason string"))
    assert {r.message for r in kept.collect()} == {2, 5}
    assert S.consensus(blocks.filter("false")).collect() == []


def plain(blocks, details):
    """The agreed values, read message by message."""
    newest = lambda r: (r["sent_at"] is not None, r["sent_at"] or 0, r["message"], -r["part"])
    out = set()
    for person in {b["person"] for b in blocks}:
        order = sorted((b for b in blocks if b["person"] == person), key=newest, reverse=True)
        mine = [{d["slot"]: d for d in details if (d["message"], d["part"]) == (b["message"], b["part"]) and d["person"] == person} for b in order]
        for slot in {s for m in mine for s in m}:
            having = [i for i, m in enumerate(mine) if slot in m]
            key = mine[having[0]][slot]["key"]
            agree = [i for i in having if mine[i][slot]["key"] == key]
            own = [i for i in agree if not order[i]["quoted"]]
            at = (own or agree)[0]
            points = 60 + 20 * order[at]["name_line"] + min(30, 10 * (len(agree) - 1)) - 20 * (having[0] > 0) - 15 * (not own)
            others, story = [key], []
            for i in having:
                d = mine[i][slot]
                if d["key"] not in others:
                    others.append(d["key"])
                    when = "an undated message" if order[i]["sent_at"] is None else time.strftime("%B %Y", time.gmtime(order[i]["sent_at"]))
                    story.append(f"was {d['value']} until {when}")
            dates = [order[i]["sent_at"] for i in agree if order[i]["sent_at"] is not None]
            out.add((person, slot, mine[at][slot]["value"], order[at]["message"], len(agree), min(dates, default=None), min(97, points) / 100, "; ".join(story[:2])))
    return out


def test_consensus(spark):
    r = random.Random(5)
    blocks, details = [], []
    for m in range(120):
        b = {"message": m, "part": r.randrange(2), "person": f"p{r.randrange(8)}", "sent_at": r.choice([None, 0, 10**9, 10**9 + 5 * 10**6 * r.randrange(9)]), "quoted": r.random() < 0.4, "name_line": r.random() < 0.5}
        blocks.append(b)
        for slot in r.sample(["title", "company", "phone:work"], r.randrange(4)):
            key = r.choice("abcd")
            details.append(b | {"slot": slot, "key": key, "value": r.choice([key, key.upper()])})
    kind = "message long, part int, person string, sent_at long, quoted boolean, name_line boolean"
    frame = lambda rows, schema: spark.createDataFrame([tuple(x.values()) for x in rows], schema)
    got = S.consensus(frame(blocks, kind), frame(details, kind + ", slot string, key string, value string"))
    assert {tuple(x) for x in got.collect()} == plain(blocks, details)
