"""Main text of web pages by wrapper induction over the pages of a host.

Each page is folded to a small tree. The commonest trees of a host that differ much are its models; every other tree is
aligned with the one that fits best by simple tree matching, once per distinct tree. A text that stands in a node on
most of the pages that have this node is template, and what varies there fills a slot. Of the slots, those named as
menus, adverts and the like, and those that are mostly links, are no content. All counts are aggregations by host, node
and text, so that no host's pages meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, id_of, key_of, materialize
from .html_core import Page, align, parse

#: Bytes of wrappers up to which they are broadcast; beyond, the pages are shuffled to them.
BROADCAST_BYTES = 32 << 20
_SLOTS = "array<struct<node:int,text:bigint,chars:int,linked:int>>"
_SLOT = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32())]))
_MOVED = "host string, model int, node int, text long, chars long, linked long, lead int"
_aligned = lru_cache(maxsize=5_000)(align)
#: A tree is a model of its own if less than this share of its nodes fits into the commoner models of its host.
_FITS = 0.7


def _name(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - 2**63


def _slots(page: Page) -> list[dict[str, int]]:
    """Each distinct text of each node, with its letters and how many of them are in links."""
    found: dict[tuple[int, str], int] = {}
    for node, text, linked in page.blocks:
        found[node, text] = max(found.get((node, text), 0), min(linked, len(text)))
    return [{"node": n, "text": _name(t), "chars": len(t), "linked": k} for (n, t), k in found.items()]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [parse(h) for h in each(batch.column("html"))]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p.skeleton() for p in pages], pa.string()), pa.array([_slots(p) for p in pages], _SLOT)], names=["host", "skeleton", "slots"])


def best_model(skeleton: str, models: list[str]) -> tuple[int, list[int]]:
    """The model that most of the tree's nodes fit into, the first of several, and the alignment with it."""
    best, most, to = -1, -1, []
    for i, model in enumerate(models):
        found = _aligned(skeleton, model)
        if (n := sum(x >= 0 for x in found)) > most:
            best, most, to = i, n, found
    return best, to


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the common trees of a host, the commonest first, those that do not fit into the ones chosen before."""
    for batch in batches:
        chosen = []
        for shapes in batch.column("shapes").to_pylist():
            models: list[str] = []
            for s in sorted(shapes, key=lambda s: (-s["n"], s["skeleton"])):
                _, to = best_model(s["skeleton"], models)
                if not models or sum(n >= 0 for n in to) < _FITS * len(to):
                    models.append(s["skeleton"])
            chosen.append(models)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(chosen, pa.list_(pa.string()))], names=["host", "models"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots by the nodes of the page's model, those without a counterpart left out; lead is 1 once for page and node."""
    names = [x.split()[0] for x in _MOVED.split(", ")]
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        rows: list[tuple] = []
        for host, skeleton, models, slots in zip(*(each(batch.column(n)) for n in ("host", "skeleton", "models", "slots")), strict=True):
            which, to = best_model(skeleton, models)
            seen: set[int] = set()
            for s in slots:
                node = to[s["node"]]
                if node >= 0:
                    rows.append((host, which, node, s["text"], s["chars"], s["linked"], int(node not in seen)))
                    seen.add(node)
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _small(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def wrappers(pages: DataFrame, *, same: float, min_pages: int, links: float, common: float) -> DataFrame:
    """host, models (skeletons), template (model, node and text that are template) and linked (model and node of menus)."""
    survey = pages.mapInArrow(_survey, f"host string, skeleton string, slots {_SLOTS}").withColumn("page", F.xxhash64("skeleton", "slots"))
    survey = materialize(survey.dropDuplicates(["host", "page"]).drop("page"))
    shapes = survey.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    totals = shapes.groupBy("host").agg(F.max(F.struct("n", "skeleton"))["skeleton"].alias("commonest"), F.sum("n").alias("pages"))
    shapes = shapes.join(totals, "host").where((F.col("skeleton") == F.col("commonest")) | (F.col("n") >= F.greatest(F.lit(min_pages), F.lit(common) * F.col("pages"))))
    listed = shapes.groupBy("host").agg(F.collect_list(F.struct("n", "skeleton")).alias("shapes"))  # 1 / common at most
    models = materialize(listed.mapInArrow(_choose, "host string, models array<string>"))
    side = F.broadcast(models) if _small(models, F.length(F.array_join("models", ""))) else models
    moved = survey.join(side, "host").mapInArrow(_moved, _MOVED)
    place = ["host", "model", "node"]
    texts = materialize(moved.groupBy(*place, "text").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("chars", "linked", "lead")]))
    nodes = texts.groupBy(*place).agg(F.sum("lead").alias("pages"), F.sum("chars").alias("all_chars"), F.sum("linked").alias("all_linked"))
    often = texts.where(F.col("n") >= min_pages).join(nodes, place).where(F.col("n") >= same * F.col("pages"))
    template = often.groupBy("host").agg(F.collect_list(F.struct("model", "node", "text")).alias("template"))
    linked = nodes.where(F.col("all_linked") > F.lit(links) * F.col("all_chars")).groupBy("host").agg(F.collect_list(F.struct("model", "node")).alias("linked"))
    return models.join(template, "host", "left").join(linked, "host", "left")


def main_text(page: Page, models: list[str], template: set[tuple[int, int, int]], linked: set[tuple[int, int]]) -> str:
    """The blocks of a page that its host's wrapper takes for content, one to a line.

    Where the page has an article or main element, only what is in it may be content. There as elsewhere, texts that
    are template and nodes that are mostly links on the host's pages are none; a node without a counterpart in the model
    is content inside of such an element, and elsewhere if it is not mostly links itself.
    """
    whole = any(page.main[n] and not page.side[n] for n, _, _ in page.blocks)
    model, to = best_model(page.skeleton(), models)
    out = []
    for node, text, in_links in page.blocks:
        if page.side[node] or whole and not page.main[node]:
            continue
        if not to or to[node] < 0:
            if whole or in_links * 2 <= len(text):
                out.append(text)
        elif (model, to[node], _name(text)) not in template and (model, to[node]) not in linked:
            out.append(text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, models, template, linked in zip(*(each(batch.column(n)) for n in ("html", "models", "template", "linked")), strict=True):
            texts.append(main_text(parse(html), models or [], {(t["model"], t["node"], t["text"]) for t in template or ()}, {(t["model"], t["node"]) for t in linked or ()}))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"])


def extract_text(pages: DataFrame, *, same: float = 0.6, min_pages: int = 5, links: float = 0.5, common: float = 0.1) -> DataFrame:
    """page_id, url and text (the article, its blocks joined by newlines) of every row of ``pages``.

    ``same``: share of the pages with a node on which one text stands there, from which this text is template, on
    ``min_pages`` pages at least. ``links``: share of characters in links beyond which a node is a menu. ``common``: share
    of a host's pages with one tree from which it may be a model. The host is that of the url; pages without one (or
    with a null url) are one host. Pages of a host with equal texts in equal trees count once, as a page that was copied
    often would make its article template.

    A null or empty html has an empty text; long, deep and broken pages take time in proportion to their length. A null
    page_id stays null; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(key_of("page_id").alias("key"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = materialize(wrappers(rows.select("host", "html"), same=same, min_pages=min_pages, links=links, common=common))
    size = F.length(F.array_join("models", "")) + 16 * F.coalesce(F.size("template"), F.lit(0)) + 8 * F.coalesce(F.size("linked"), F.lit(0))
    side = F.broadcast(found) if _small(found, size) else found
    out = rows.join(side, "host", "left").select("key", "url", "html", "models", "template", "linked").mapInArrow(_extract, "key long, url string, text string")
    return out.select(id_of().alias("page_id"), "url", "text")
