"""An account's changed cards, page after page, merged field by field into one's own: each run is seen at once or not at all."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.generations import Generations
from brindle.sources.store import drop, kept

BUCKETS = 16
#: A run that takes more cards away than this share of those linked, and more than LEAST_HELD, waits to be allowed.
MOST_GONE, LEAST_HELD = 1 / 3, 5
PAGE = "id long, version long, fields map<string,string>, edited_ms long, gone boolean"
FIELDS, BASE, STATES, TOKENS = "id long, field string, value string, edited_ms long, b int", "id long, field string, value string, b int", "id long, state string, b int", "id long, seq long, token string, b int"
#: The key of rows that no card owns.
NOBODY = -(2**63)


def _bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))


def latest(pages: DataFrame) -> DataFrame:
    """(id, fields, edited_ms, gone): each card as the last version in the pages has it. Null ids are no cards, null
    fields none; rows of one version that differ count by the later edit, then as gone."""
    order = F.struct("version", "edited_ms", F.coalesce("gone", F.lit(False)), F.to_json("fields"))
    last = F.max_by(F.struct("fields", "edited_ms", F.coalesce("gone", F.lit(False)).alias("gone")), order)
    return pages.filter("id is not null").groupBy("id").agg(last.alias("c")).select("id", "c.*")


def merged(base: DataFrame, local: DataFrame, remote: DataFrame, edited: DataFrame) -> DataFrame:
    """(id, field, value, edited_ms, remote, conflict) of three versions of fields.

    base: (id, field, value) as last agreed; local: (id, field, value, edited_ms), a null value is a field that was
    cleared; remote: (id, field, value) of whole cards and edited: (id, edited_ms) of them, which is also when a field that
    a card lacks was cleared there. A side that is as the base gives way; if both differ from it and from
    each other, the later edit wins, the account's if they are as late.
    """
    b = base.select("id", "field", F.col("value").alias("b"))
    l = local.select("id", "field", F.col("value").alias("l"), F.col("edited_ms").alias("l_ms"))  # noqa: E741
    r = remote.select("id", "field", F.col("value").alias("r"))
    met = b.join(l, ["id", "field"], "full").join(r, ["id", "field"], "full").join(edited.select("id", F.col("edited_ms").alias("r_ms")), "id", "left")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    conflict = ~same("l", "r") & ~same("b", "l") & ~same("b", "r")
    own = same("b", "r") | (conflict & (F.coalesce("l_ms", F.lit(-1)) > F.coalesce("r_ms", F.lit(-1))))
    value, ms = F.when(own, F.col("l")).otherwise(F.col("r")), F.when(own | same("l", "r"), F.col("l_ms")).otherwise(F.col("r_ms"))
    return met.select("id", "field", value.alias("value"), ms.alias("edited_ms"), F.col("r").alias("remote"), conflict.alias("conflict"))


class ContactSync:
    """Cards and what one account was last seen to hold, in a folder that all writers and readers share.

    Pages are staged under the token that they were asked for with, so a page that is pulled again replaces itself
    and a run that was broken off goes on at the first page that it lacks. Only a finished run changes the cards: all of its
    changes and the next token become one generation. How the changes were cut into pages is of no account.
    """

    def __init__(self, spark: SparkSession, folder: str, cards: DataFrame | None = None, base: DataFrame | None = None):
        """cards: (id, field, value, edited_ms), base: (id, field, value); both only for a new folder."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.generations = Generations(spark, f"{self.folder}/cards")
        if not self.generations.newest().tables:
            linked = None if base is None else base.select("id").distinct().withColumn("state", F.lit("synced"))
            paths = {}
            for name, (schema, df) in {"fields": (FIELDS, cards), "base": (BASE, base), "states": (STATES, linked), "tokens": (TOKENS, None)}.items():
                # A row of nobody keeps a table without rows from being a folder without a schema.
                columns = len(schema.split(",")) - 2
                rows = spark.createDataFrame([(NOBODY, *[None] * columns, 0)], schema)
                if df is not None:
                    rows = rows.unionByName(_bucket(df.filter("id is not null")).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))
                paths[name] = f"{self.folder}/first/{name}"
                rows.write.mode("overwrite").partitionBy("b").parquet(paths[name])
            self.generations.create({n: (p, "id", "b", ("id",)) for n, p in paths.items()})

    def rows(self, name: str) -> DataFrame:
        """fields, base or states as of the last finished run."""
        return self.generations.rows(self.generations.newest(), name).filter(F.col("id") != NOBODY).drop("b")

    def position(self) -> tuple[int, str | None]:
        """(number of finished runs, token to go on with)."""
        m = self.generations.newest()
        last = self.generations.rows(m, "tokens").filter("seq is not null").orderBy(F.desc("seq")).limit(1).collect()
        return (last[0]["seq"], last[0]["token"]) if last else (0, None)

    # ---- pages

    def _page(self, seq: int, token: str | None) -> str:
        return f"{self.folder}/runs/{seq}/{hashlib.md5(repr(token).encode()).hexdigest()}"

    def _after(self, page: str) -> dict | None:
        """What the note beside a page that is staged whole says."""
        g, note = self.generations, f"{page}.json"
        return json.loads(g._read(note)) if g._fs.exists(g._path(note)) else None

    def stage(self, rows: DataFrame, token: str | None, following: str | None, done: bool) -> None:
        """Keeps one page; `following` is the token of the next page, or of the next run if the page is the last."""
        page, g = self._page(self.position()[0], token), self.generations
        rows.select("id", "version", "fields", "edited_ms", "gone").write.mode("overwrite").parquet(page)
        stream = g._fs.create(g._path(f"{page}.json"), True)
        stream.write(bytearray(json.dumps({"next": following, "done": done}).encode()))
        stream.close()

    def pull(self, provider: Callable[[str | None], tuple[DataFrame, str | None, bool]]) -> None:
        """Stages the pages of a run that aren't yet. provider: token to (page, next token, whether it is the last)."""
        seq, token = self.position()
        while True:
            note = self._after(self._page(seq, token))
            if note is None:
                rows, following, done = provider(token)
                self.stage(rows, token, following, done)
                note = {"next": following, "done": done}
            if note["done"]:
                return
            token = note["next"]

    def _staged(self) -> tuple[list[str], int, str | None]:
        """Pages of the run that is staged whole, its number and the token after it."""
        seq, token = self.position()
        pages: list[str] = []
        while True:
            page = self._page(seq, token)
            note = self._after(page)
            if note is None:
                raise ValueError("the run lacks pages: pull first")
            pages.append(page)
            token = note["next"]
            if note["done"]:
                return pages, seq, token

    # ---- a run

    def finish(self, full: bool = False, master: bool = False, allow: bool = False) -> bool:
        """Merges the staged run; False if it is held, as it would take too many cards away and isn't allowed to.

        full: the pages hold all cards of the account, so linked cards that aren't in them are gone. Cards that
        are gone stay, marked deleted_remote; with master, they go here too.
        """
        pages, seq, token = self._staged()
        now = kept(latest(self.spark.read.schema(PAGE).parquet(*pages)), "changed-cards")
        linked = self.rows("states").filter("state = 'synced'").select("id")
        gone = linked.join(now.filter("gone").select("id"), "id", "left_semi")
        if full:
            gone = gone.unionByName(linked.join(now.select("id"), "id", "left_anti"))
        gone = kept(gone, "gone-cards")
        n = gone.count()
        if not allow and n > LEAST_HELD and n > MOST_GONE * linked.count():
            drop(now, gone)
            return False
        live = now.filter("not gone")
        touched = live.select("id").unionByName(gone.select("id"))
        mine = self.rows("fields")
        remote = live.select("id", F.explode("fields").alias("field", "value"))
        base = self.rows("base").join(live.select("id"), "id", "left_semi")
        local = mine.join(live.select("id"), "id", "left_semi")
        out = kept(merged(base, local, remote, live), "merged-cards")
        # A field that is cleared here and still there stays as a null, to be sent.
        fields = out.filter("value is not null or remote is not null").select("id", "field", "value", "edited_ms")
        states = live.select("id", F.lit("synced").alias("state"))
        if not master:
            fields = fields.unionByName(mine.join(gone, "id", "left_semi").select("id", "field", "value", "edited_ms"))
            states = states.unionByName(gone.select("id", F.lit("deleted_remote").alias("state")))
        tokens = self.spark.createDataFrame([(NOBODY, seq + 1, token)], "id long, seq long, token string")
        rows = {"fields": fields, "base": remote.filter("value is not null").select("id", "field", "value"), "states": states, "tokens": tokens}
        self.generations.write({n: _bucket(df) for n, df in rows.items()}, touched)
        drop(now, gone, out)
        return True

    def edit(self, changed: DataFrame) -> None:
        """One's own edits (id, field, value, edited_ms) of some fields; a null value clears one. A folder has one writer at a time."""
        ids = changed.select("id").filter("id is not null").distinct()
        rest = self.rows("fields").join(ids, "id", "left_semi").join(changed.select("id", "field"), ["id", "field"], "left_anti")
        own = rest.unionByName(changed.filter("id is not null").select("id", "field", "value", "edited_ms"))
        same = {n: self.rows(n).join(ids, "id", "left_semi") for n in ("base", "states")}
        self.generations.write({n: _bucket(df) for n, df in ({"fields": own} | same).items()}, ids)

    def to_send(self) -> DataFrame:
        """(id, field, value) that linked cards hold and the account doesn't yet; a null value is to be cleared there."""
        linked = self.rows("states").filter("state = 'synced'").select("id")
        ours = self.rows("fields").join(linked, "id", "left_semi").select("id", "field", F.col("value").alias("l"))
        both = ours.join(self.rows("base").select("id", "field", F.col("value").alias("r")), ["id", "field"], "left")
        return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select("id", "field", F.col("l").alias("value"))

    def compact(self) -> None:
        """Rewrites the buckets that lie in several folders."""
        for name in ("fields", "base", "states"):
            some = self.generations.touched(self.generations.newest(), name)
            if some:
                self.generations.compact(name, some)
