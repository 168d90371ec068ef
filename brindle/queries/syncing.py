"""Cards held against the changes of an account, which come in pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.operators.contact_sync import ContactSync
from brindle.queries.registry import query
from brindle.sources.corpus import Corpus
from brindle.sources.store import shared_dir

#: When one's own cards were edited, and the number from which cards are new.
EDITED_MS, NEW, PAGES = 883_612_800_000, 1_000_000_000_000, 3

SYNCED = f"""
WITH v AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + {NEW} ELSE o_custkey END AS id, o_orderkey, o_orderkey % 11 = 0 AS gone, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 AS ms, CASE WHEN o_orderkey % 2 = 0 THEN printf('Customer#%09d', o_custkey) ELSE printf('Client %d', o_custkey) END AS name, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 2 THEN 'BUILDING' END AS segment FROM orders),
last AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY o_orderkey DESC) = 1),
live AS (SELECT * FROM last WHERE NOT gone),
remote AS (SELECT id, 'name' AS field, name AS r FROM live UNION ALL SELECT id, 'segment', segment FROM live WHERE segment IS NOT NULL),
base AS (SELECT c_custkey AS id, 'name' AS field, c_name AS b FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer),
own AS (SELECT id, field, CASE WHEN field = 'name' AND id % 4 = 0 THEN b || ' L' WHEN field = 'segment' AND id % 9 = 0 THEN NULL ELSE b END AS l, CASE WHEN (field = 'name' AND id % 4 = 0) OR (field = 'segment' AND id % 9 = 0) THEN {EDITED_MS} ELSE 0 END AS l_ms FROM base),
met AS (SELECT * FROM (SELECT * FROM base WHERE id IN (SELECT id FROM live)) FULL JOIN (SELECT * FROM own WHERE id IN (SELECT id FROM live)) USING (id, field) FULL JOIN remote USING (id, field) LEFT JOIN (SELECT id, ms AS r_ms FROM live) USING (id)),
won AS (SELECT *, l IS DISTINCT FROM r AND b IS DISTINCT FROM l AND b IS DISTINCT FROM r AS conflict FROM met),
mine AS (SELECT *, b IS NOT DISTINCT FROM r OR (conflict AND coalesce(l_ms, -1) > coalesce(r_ms, -1)) AS keeps FROM won),
now AS (SELECT id, field, CASE WHEN keeps THEN l ELSE r END AS value, CASE WHEN keeps OR l IS NOT DISTINCT FROM r THEN l_ms ELSE r_ms END AS edited_ms, r FROM mine),
fields AS (SELECT id, field, value, edited_ms, value IS DISTINCT FROM r AS send FROM now WHERE value IS NOT NULL OR r IS NOT NULL UNION ALL SELECT id, field, l, l_ms, l IS DISTINCT FROM b FROM own JOIN base USING (id, field) WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, field, l, l_ms, false FROM own WHERE id IN (SELECT id FROM last WHERE gone))
SELECT id, field, value, edited_ms, CASE WHEN id IN (SELECT id FROM last WHERE gone) THEN 'deleted_remote' ELSE 'synced' END AS state, send FROM fields
"""


@query("contact_sync", SYNCED)
def contact_sync(c: Corpus):
    # An order is a version of its customer's card at the account; a seventh of them belong to cards that aren't known here.
    customer = c.table("customer")
    unit = lambda field, column: customer.select(F.col("c_custkey").alias("id"), F.lit(field).alias("field"), F.col(column).alias("value"))
    base = unit("name", "c_name").unionByName(unit("segment", "c_mktsegment"))
    renamed, cleared = (F.col("field") == "name") & (F.col("id") % 4 == 0), (F.col("field") == "segment") & (F.col("id") % 9 == 0)
    value = F.when(renamed, F.concat("value", F.lit(" L"))).when(~cleared, F.col("value"))
    own = base.select("id", "field", value.alias("value"), F.when(renamed | cleared, EDITED_MS).otherwise(0).alias("edited_ms"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(key % 2 == 0, F.format_string("Customer#%09d", who)).otherwise(F.format_string("Client %d", who))
    segment = F.when(key % 3 == 0, F.col("o_orderpriority")).when(key % 3 == 2, "BUILDING")
    changes = c.table("orders").select(
        F.when(key % 7 == 0, who + NEW).otherwise(who).alias("id"), key.alias("version"),
        F.map_filter(F.create_map(F.lit("name"), name, F.lit("segment"), segment), lambda _, v: v.isNotNull()).alias("fields"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).cast("long") * 86_400_000).alias("edited_ms"), (key % 11 == 0).alias("gone"),
    )

    def provider(token: str | None):
        page = int(token or 0)
        return changes.filter(F.col("version") % PAGES == page), str(page + 1), page + 1 == PAGES

    sync = ContactSync(c.spark, f"{shared_dir(c.spark)}/contacts-{uuid.uuid4().hex}", own, base)
    sync.pull(provider)
    sync.finish(allow=True)
    send = sync.to_send().select("id", "field", F.lit(True).alias("s"))
    out = sync.rows("fields").join(sync.rows("states"), "id", "left").join(send, ["id", "field"], "left")
    return out.select("id", "field", "value", "edited_ms", "state", F.coalesce("s", F.lit(False)).alias("send"))
