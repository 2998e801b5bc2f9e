"""Main text of web pages by wrapper induction.

Method: the skeleton tree of a page has one node per kind of element.  The most frequent
skeleton of a host is its reference; every page of the host is aligned to it by simple tree
matching, and each place of the reference gathers how many pages have it, how much text it
holds and whether that text is the same everywhere.  Constant places are template, varying
ones are slots.  The wrapper of a host names its content places: the article or main element
if the host marks one, else the smallest place that covers all varying text outside boilerplate,
so that a title and a lead beside the body stay.  A page's content is what it has at those places,
without parts marked as boilerplate and, outside articles, without template.  Inside an article
nothing is template: what an article says on every page is still said.

Counts go by different pages: of equal pages of a host each counts as its share of one, so that
copies do not make each other's text template, nor their skeleton the reference.

Null html: empty text.  Null url: one host.  Equal pages give equal texts.  Counts are combined
before they are shuffled, so a host with a third of all pages is a few rows per task; wrappers
reach the pages by a size-checked join.  Other columns of the input are not returned."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import slices
from wordloom.llm.dom import Node, Tree, boilerplate, is_boilerplate, match, parse, skeleton
from wordloom.session import bounded_join, written

MIN_PAGES = 3  # different pages a place needs before equal text makes it template
WRAPPER_BYTES = 16_384
BATCH_BYTES = 4 << 20


def dump(tree: Tree) -> str:
    return json.dumps(tree, separators=(",", ":"))


@lru_cache(4_096)
def tree_of(text: str) -> Tree:
    keys, sizes = json.loads(text)
    return tuple(keys), tuple(sizes)


@lru_cache(16_384)
def aligned(page: str, reference: str) -> dict[int, int]:
    """Place in the page's skeleton -> place in the reference."""
    return match(tree_of(page), tree_of(reference))


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def with_share(pages: DataFrame) -> DataFrame:
    """`pages` with `share`: one over the number of equal pages of the host."""
    copies = pages.groupBy("host", F.xxhash64("html").alias("same")).agg(F.count("*").alias("copies")).where("copies > 1")
    marked = bounded_join(pages.withColumn("same", F.xxhash64("html")), written(copies), ["host", "same"], None, 96)
    return marked.withColumn("share", 1 / F.coalesce("copies", F.lit(1))).drop("same", "copies")


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, skeleton, pages), counted within batches; sum it up by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for part in slices(batch, "html", BATCH_BYTES):
                rows = part.to_pydict()
                for host, page, share in zip(rows["host"], rows["html"], rows["share"]):
                    counts[host, dump(skeleton(parse(page)[0])[0])] += share
            yield pa.RecordBatch.from_pydict(
                {"host": [k[0] for k in counts], "skeleton": [k[1] for k in counts], "pages": pa.array(list(counts.values()), pa.float64())}
            )

    return pages.select("host", "html", "share").mapInArrow(run, "host string, skeleton string, pages double")


def references(pages: DataFrame) -> DataFrame:
    """(host, reference): the most frequent skeleton, ties to the smaller string."""
    counted = skeletons(pages).groupBy("host", "skeleton").agg(F.round(F.sum("pages")).alias("n"))
    return counted.groupBy("host").agg(F.min_by("skeleton", F.struct(-F.col("n"), "skeleton")).alias("reference"))


def place_texts(pages: DataFrame) -> DataFrame:
    """(host, place, pages, chars, low, high) of pages with their `reference`: over each place
    the different pages that have it, characters, and the least and greatest hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list] = {}
            for part in slices(batch, "html", BATCH_BYTES):
                rows = part.to_pydict()
                for host, page, reference, share in zip(rows["host"], rows["html"], rows["reference"], rows["share"]):
                    nodes, blocks = parse(page)
                    tree, places = skeleton(nodes)
                    to = aligned(dump(tree), reference)
                    texts = defaultdict(list)
                    for node, text in blocks:
                        texts[places[node]].append(text)
                    for place, mine in texts.items():
                        if place in to:
                            joined = "\n".join(mine)
                            digest = int.from_bytes(hashlib.blake2b(joined.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                            got = seen.setdefault((host, to[place]), [0.0, 0, digest, digest])
                            got[0] += share
                            got[1] += len(joined)
                            got[2], got[3] = min(got[2], digest), max(got[3], digest)
            values = list(seen.values())
            yield pa.RecordBatch.from_pydict(
                {"host": pa.array([k[0] for k in seen], pa.string()), "place": pa.array([k[1] for k in seen], pa.int32())}
                | {"pages": pa.array([v[0] for v in values], pa.float64())}
                | {c: pa.array([v[i] for v in values], pa.int64()) for i, c in enumerate(("chars", "low", "high"), 1)}
            )

    schema = "host string, place int, pages double, chars bigint, low bigint, high bigint"
    return pages.select("host", "html", "reference", "share").mapInArrow(run, schema)


def content_places(reference: str, stats: dict[int, tuple[int, int, bool]]) -> list[int]:
    """Places of the content in a reference.  stats: place -> (pages, chars, constant)."""
    keys, sizes = tree_of(reference)
    for tag in ("article", "main"):
        outer, end = [], 0
        for i, key in enumerate(keys):
            if i >= end and key.split(".")[0] == tag:
                outer.append(i)
                end = i + sizes[i]
        if outer:
            return outer
    wanted, end = [], 0
    for i, key in enumerate(keys):
        if i < end:
            continue
        if is_boilerplate(key):
            end = i + sizes[i]
        elif i in stats and stats[i][1] and not stats[i][2]:
            wanted.append(i)
    if not wanted:
        return [0]
    covering = [i for i in range(len(keys)) if i <= wanted[0] and wanted[-1] < i + sizes[i]]
    return [covering[-1]]


def wrappers(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, reference, content, template): the wrapper of each host."""
    n = refs.count()
    joined = bounded_join(pages, refs, "host", n, WRAPPER_BYTES, how="inner")
    stats = place_texts(joined).groupBy("host", "place").agg(
        F.round(F.sum("pages")).alias("pages"), F.sum("chars").alias("chars"), (F.min("low") == F.max("high")).alias("constant")
    )
    constant = F.col("constant") & (F.col("pages") >= MIN_PAGES)
    per_host = stats.groupBy("host").agg(
        F.collect_list(F.struct("place", "pages", "chars", constant.alias("constant"))).alias("stats")
    )  # a host has as many places as its reference has nodes
    both = refs.join(per_host, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            content, template = [], []
            for reference, own in zip(rows["reference"], rows["stats"]):
                by_place = {s["place"]: (s["pages"], s["chars"], s["constant"]) for s in own or []}
                content.append(content_places(reference, by_place))
                template.append(sorted(p for p, s in by_place.items() if s[2]))
            yield pa.RecordBatch.from_pydict(
                {
                    "host": rows["host"],
                    "reference": rows["reference"],
                    "content": pa.array(content, pa.list_(pa.int32())),
                    "template": pa.array(template, pa.list_(pa.int32())),
                }
            )

    return both.mapInArrow(run, "host string, reference string, content array<int>, template array<int>")


def semantic_roots(nodes: list[Node], junk: list[bool]) -> list[int]:
    """Outermost clean article elements, else main elements."""
    for tag in ("article", "main"):
        found = [i for i, x in enumerate(nodes) if x.tag == tag and not junk[i]]
        if found:
            mine, out = set(found), []
            for i in found:
                p = nodes[i].parent
                while p > 0 and p not in mine:
                    p = nodes[p].parent
                if p <= 0:
                    out.append(i)
            return out
    return []


def main_text(page: str, reference: str, content: list[int], template: list[int]) -> str:
    """Text of a page under the wrapper of its host."""
    nodes, blocks = parse(page)
    junk = boilerplate(nodes)
    tree, places = skeleton(nodes)
    to = aligned(dump(tree), reference)
    wanted = set(content)
    roots = {i for i in range(len(nodes)) if to.get(places[i]) in wanted and not junk[i]}
    marked = semantic_roots(nodes, junk)
    if marked and not any(nodes[i].tag in ("article", "main") for i in roots):
        roots = set(marked)
    if not roots:
        roots = {0}
    free = any(nodes[i].tag in ("article", "main") for i in roots)  # inside, nothing is template
    fixed = set() if free else set(template)
    inside = [False] * len(nodes)
    for i in range(len(nodes)):
        inside[i] = i in roots or (i > 0 and inside[nodes[i].parent])
    return "\n".join(t for i, t in blocks if inside[i] and not junk[i] and to.get(places[i]) not in fixed)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    hosted = with_share(with_host(pages))
    refs = written(references(hosted))
    rules = written(wrappers(hosted, refs))
    joined = bounded_join(hosted, rules, "host", rules.count(), WRAPPER_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", BATCH_BYTES):
                rows = part.to_pydict()
                texts = [
                    main_text(*row) for row in zip(rows["html"], rows["reference"], rows["content"], rows["template"])
                ]
                yield pa.RecordBatch.from_pydict(
                    {"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string())}
                    | {"n_chars": pa.array([len(t) for t in texts], pa.int64())}
                )

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return joined.select("page_id", "url", "html", "reference", "content", "template").mapInArrow(run, schema)
