"""The life of page structures: matched, adapted and learned variants, and the records of a monitor.

Both go through a key's pages in order, each deciding against what earlier ones left: sequential by definition within a
key. State is a key's variants, or one page, never its history.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F

from quern.operators.limits import fold
from quern.operators.structure import change_similarity, variant_similarity
from quern.operators.variants import Variants

#: What a structure must carry for the comparisons.
COLUMNS = (
    "tag_counts", "css_class_map", "css_class_rank", "id_attributes", "semantic_landmarks", "content_regions", "navigation_selectors", "pagination", "content_hash",
)


def life_cycle(rows: DataFrame, *, known: DataFrame | None = None, least: float = 0.85, breaking: float = 0.70, seconds: int | None = None) -> DataFrame:
    """(key, page_id, variant_id, action, similarity, version) for each of `rows` (key, seq, at, page_id, fingerprint and the
    structure's columns), seq the order and at the time in seconds.

    A page whose most similar variant reaches `least` matches it. The stored structure is compared: under `breaking` the
    strategy is adapted and the page becomes the variant's next version; else nothing is saved. A variant saved more than
    `seconds` before is an orphan and is learned anew. A page that matches none is learned as a new variant. `known` are the variants
    of earlier calls in their newest versions, as `stored` gives them; with them the result is that of one call over
    all rows, where later calls have the later seqs.
    """

    def step(state: tuple[Variants, Counter], r: dict) -> tuple[tuple, tuple]:
        variants, names = state
        if r["saved"] is not None:
            base, _, n = r["saved"].partition("~")
            names[base] = max(names[base], int(n or 0) + 1)
            variants.add({c: r[c] for c in COLUMNS} | {"id": r["saved"], "version": int(r["saved_version"]), "at": r["at"]})
            return state, (r["key"], r["page_id"], r["saved"], "known", None, int(r["saved_version"]))
        now = {c: r[c] for c in COLUMNS} | {"id": r["fingerprint"], "version": 1, "at": r["at"]}
        _, i = variants.best(now)
        if i is None:
            taken = names[r["fingerprint"]]  # a fingerprint that another variant has
            names[r["fingerprint"]] += 1
            now["id"] += f"~{taken}" if taken else ""
            variants.add(now)
            return state, (r["key"], r["page_id"], now["id"], "learned", None, 1)
        v = variants.items[i]
        same = change_similarity(v, now)
        action = "relearned" if seconds is not None and r["at"] - v["at"] > seconds else "adapted" if round(same, 9) < breaking else "matched"
        if action != "matched":
            v = now | {"id": v["id"], "version": v["version"] + 1}
            variants.replace(i, v)
        return state, (r["key"], r["page_id"], v["id"], action, round(same, 9), v["version"])

    cols = ["key", "seq", "at", "page_id", "fingerprint", *COLUMNS]
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select(*cols, none("string").alias("saved"), none("int").alias("saved_version"), none("bigint").alias("place"))
    if known is not None:
        seq = none(rows.schema["seq"].dataType)
        both = both.unionByName(known.select("key", seq.alias("seq"), "at", "page_id", none("string").alias("fingerprint"), *COLUMNS, F.col("variant_id").alias("saved"), F.col("version").alias("saved_version"), "place"))
    schema = "key string, page_id long, variant_id string, action string, similarity double, version int"
    return fold(both, "key", ["seq", "place", "saved"], lambda: (Variants(least, variant_similarity), Counter()), step, schema).where("action <> 'known'")


VERSION = ("key", "variant_id", "version", "place", "at", "page_id", *COLUMNS)


def versions(life: DataFrame, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What a store keeps of `life`, the life cycle of `rows`: a row (VERSION) for each version that was learned or adapted, with the
    page's structure. `place` orders a key's variants by their start: the seq (a number) of a variant's first page, after the places of the known ones."""
    changed = life.where("action <> 'matched'").select("key", "page_id", "variant_id", "version")
    new = changed.join(rows.select("key", "page_id", "at", F.col("seq").cast("bigint").alias("place"), *COLUMNS), ["key", "page_id"])
    first = new.groupBy("key", "variant_id").agg(F.min("place").alias("place"))
    if known is not None:
        of_key = known.groupBy("key").agg(F.max("place").alias("last"))
        old = known.select("key", "variant_id", F.col("place").alias("was"))
        first = first.join(old, ["key", "variant_id"], "left").join(of_key, "key", "left")
        low = F.min("place").over(Window.partitionBy("key"))
        first = first.select("key", "variant_id", F.coalesce("was", F.col("place") - low + F.col("last") + 1, "place").alias("place"))
    return new.drop("place").join(first, ["key", "variant_id"]).select(*VERSION)


def stored(versions: DataFrame) -> DataFrame:
    """The newest version of each variant."""
    rest = [c for c in VERSION if c not in ("key", "variant_id")]
    return versions.groupBy("key", "variant_id").agg(F.max_by(F.struct(*rest), "version").alias("_r")).select("key", "variant_id", "_r.*")


def visits(rows: DataFrame, *, breaking: float = 0.70) -> DataFrame:
    """What a monitor makes of each visit, and what it knows afterwards: key, page_id, change_type (null where nothing changed),
    similarity, previous_hash, current_hash, version, stored (the row whose structure is stored) and n (the visit's number).

    `rows` are (key, seq, row, page_id, hash, known_version and the structure's columns). A row of null seq is what is known of its
    key from before: the stored page, its structure and version, and the hash of the last visit; it is no visit, and n is 0.
    """

    def step(s: dict, r: dict) -> tuple[dict, tuple]:
        if r["known_version"]:
            s = {"hash": r["hash"], "stored": {c: r[c] for c in COLUMNS}, "row": r["row"], "version": int(r["known_version"]), "n": 0}
            return s, (r["key"], r["page_id"], None, None, r["hash"], r["hash"], s["version"], r["row"], 0)
        n = s.get("n", 0) + 1
        if s.get("hash") == r["hash"]:
            return s | {"n": n}, (r["key"], r["page_id"], None, None, s["hash"], r["hash"], s["version"], s["row"], n)
        now, kind, same, before = {c: r[c] for c in COLUMNS}, "new_content", 1.0, s.get("hash")
        stored, version = s.get("stored"), s.get("version", 1)
        if stored is not None:
            same = round(change_similarity(stored, now), 9)
            kind = "structure_changed" if same < breaking else "content_updated"
            version += kind == "structure_changed"
        keep, at = (now, r["row"]) if kind != "content_updated" else (stored, s["row"])
        return {"hash": r["hash"], "stored": keep, "row": at, "version": version, "n": n}, (r["key"], r["page_id"], kind, same, before, r["hash"], version, at, n)

    cols = ["key", "seq", "row", "page_id", "hash", "known_version", *COLUMNS]
    schema = "key string, page_id long, change_type string, similarity double, previous_hash string, current_hash string, version int, stored long, n long"
    return fold(rows.select(*cols), "key", ["seq", "row"], dict, step, schema)


RECORD = ("key", "page_id", "change_type", "similarity", "previous_hash", "current_hash", "version")


def monitor(rows: DataFrame, *, breaking: float = 0.70) -> DataFrame:
    """(key, page_id, change_type, similarity, previous_hash, current_hash, version) for each visit that finds a change, of
    `rows` (key, seq, page_id, hash and the structure's columns).

    A visit with the hash of the last one finds none. Else the first is new_content; a similarity to the stored structure
    under `breaking` is structure_changed, and the page is stored as its next version; anything else is content_updated.
    """
    done = visits(rows.withColumn("known_version", F.lit(0)).withColumn("row", F.col("page_id")), breaking=breaking)
    return done.where(F.col("change_type").isNotNull()).select(*RECORD)


def with_strategy(structures: DataFrame, strategies: DataFrame, key: list[str]) -> DataFrame:
    """Structures with the newest version of their key's strategy, as a struct `strategy`; null where there is none."""
    rest = [c for c in strategies.columns if c not in key]
    newest = strategies.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("strategy"))
    return structures.join(newest, key, "left")
