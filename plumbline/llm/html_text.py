"""Main text of pages by wrapper induction.

Pages of a host are made by the same template. A host's reference is its most frequent
tree shape; each page's tree is aligned to it by simple tree matching, and of each node of
the reference it is counted how often pages of different main texts have the same text
there. The smallest subtree that holds most of the varying text outside of links is where content is, or
the main part or article that holds half of it, if markup names one; a varying first heading elsewhere belongs to it.

What is constant outside of that is template. Within it, articles may share a heading or a lead, so
* of a named main part or article nothing goes,
* of another container, constant text goes from its front and its end, and stays between texts that vary,
* if content has no container but the page's body, constant text goes, but for headings of the body between texts that vary.

Only pages that have the constant text in a node lose it. Menus, headers, footers, sidebars,
notices, adverts, forms and comments that markup names as such are left out throughout.

What is counted goes by host and shape, or by host, node and text, with partial sums before
each shuffle, so a host with a third of all pages is no group of its own anywhere. Pages
themselves are read twice and not shuffled, unless the wrappers outgrow a broadcast.

A null or empty page has the text "" and 0 characters. A host of one page, and a page that the
wrapper does not fit, is judged by its own tree alone. Pages without a host are one host.
Repeated rows are reported once a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.dom import Folded, Node, align, blocks_of, fold, parse
from plumbline.llm.tables import for_workers, settle
from plumbline.llm.url_filter import host_and_path

#: A node is template if this share of a host's distinct main texts come with the same text in
#: it, of this many texts at least; content holds this share of the varying text.
CONSTANT, LEAST, MOST_OF = 0.6, 4, 0.8
_CACHE = 4096


def _below(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            out[p].append(i)
    return out


def _content_root(parents: list[int], mass: list[float]) -> int:
    """The deepest place whose subtree still has most of all mass."""
    total = list(mass)
    for i in range(len(parents) - 1, 0, -1):
        total[parents[i]] += total[i]
    below, at = _below(parents), 0
    while below[at] and total[0] > 0:
        best = max(below[at], key=lambda i: total[i])
        if total[best] < MOST_OF * total[0]:
            break
        # a place for paragraphs or headings alone is not a container of a whole text
        if not below[best] and mass[best] > 0:
            break
        at = best
    return at


#: What goes of the constant text under the root: all, what is at the ends, nothing.
_ALL, _ENDS, _NOTHING = range(3)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _tag(label: str) -> str:
    return label.split(".")[0]


def _chosen_root(parents: list[int], labels: list[str], mass: list[float]) -> tuple[int, int]:
    """The main part or article, where markup names one that holds half of all mass, else
    where most of it is; with it, what goes of the constant text there."""
    total = list(mass)
    for i in range(len(total) - 1, 0, -1):
        total[parents[i]] += total[i]
    for name in ("main", "article"):
        for i, label in enumerate(labels):
            if _tag(label) == name and 2 * total[i] >= total[0]:
                return i, _NOTHING
    root = _content_root(parents, mass)
    return root, _ALL if _tag(labels[root]) in ("", "html", "body") else _ENDS


def _own_root(page: Folded) -> set[int]:
    """By one page alone: its articles or main part if it has text, else where most text is."""
    sizes = [float(sum(map(len, t)) - link) for t, link in zip(page.texts, page.linked, strict=True)]
    for names in (("main",), ("article",)):
        found = {i for i, label in enumerate(page.labels) if _tag(label) in names}
        total = list(sizes)
        for i in range(len(total) - 1, 0, -1):
            total[page.parents[i]] += total[i]
        if sum(total[i] for i in found) > 0:
            return found
    return {_content_root(page.parents, sizes)}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, nodes = [], []
        for page in batch.column("_html").to_pylist():
            folded = fold(parse(page or ""))
            shapes.append(json.dumps(folded.shape()))
            texts = ["".join(t) for t in folded.texts]
            main = max(texts, key=len)
            main_hash = _hash(main)
            nodes.append(
                [
                    {"place": i, "text": _hash(t), "chars": len(t) - link, "main": main_hash}
                    for i, (t, link) in enumerate(zip(texts, folded.linked, strict=True))
                    if t
                ]
            )
        kind = pa.struct([("place", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("main", pa.int64())])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(shapes), pa.array(nodes, pa.list_(kind))], names=["host", "shape", "nodes"])


_NODES = "array<struct<place: int, text: long, chars: long, main: long>>"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves a page's nodes to the places of its host's reference."""
    known: dict[tuple[str, str], list[int]] = {}
    kind = pa.struct([("place", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("main", pa.int64())])
    for batch in batches:
        out = []
        for shape, reference, nodes in zip(*(batch.column(c).to_pylist() for c in ("shape", "reference", "nodes")), strict=True):
            to = known.get((shape, reference))
            if to is None:
                if len(known) > _CACHE:
                    known.clear()
                to = known[shape, reference] = align(tuple(map(tuple, json.loads(shape))), tuple(map(tuple, json.loads(reference))))
            out.append([n | {"place": to[n["place"]]} for n in nodes if to[n["place"]] >= 0])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(kind))], names=["host", "nodes"])


def wrappers(pages: DataFrame) -> DataFrame:
    """Per host: reference, and of its places how much text they hold and which text is template."""
    shaped = settle(pages.select("host", "_html").mapInArrow(_shaped, f"host string, shape string, nodes {_NODES}"))
    shapes = shaped.groupBy("host", "shape").count()
    reference = shapes.groupBy("host").agg(F.max_by("shape", F.struct("count", "shape")).alias("reference"))
    aligned = shaped.join(reference, "host").select("host", "shape", "reference", "nodes").mapInArrow(_aligned, f"host string, nodes {_NODES}")
    nodes = aligned.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    # pages of one main text count once for a text
    distinct = nodes.groupBy("host", "place", "text", "main").agg(F.max("chars").alias("chars"))
    per_text = distinct.groupBy("host", "place", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    most = F.max(F.struct("n", "text")).alias("most")
    per_place = per_text.groupBy("host", "place").agg(F.sum("n").alias("n"), most, F.sum("chars").alias("chars"))
    constant = (F.col("n") >= LEAST) & (F.col("most.n") >= CONSTANT * F.col("n"))
    place = F.struct("place", F.when(constant, F.col("most.text")).alias("constant"), "chars", "n")
    per_host = per_place.groupBy("host").agg(F.collect_list(place).alias("places"))
    return per_host.join(reference, "host").select("host", "reference", "places")


_ROOTED = "host string, reference string, root int, goes int, heads array<int>, template array<struct<place: int, text: long>>"


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"root": [], "goes": [], "heads": [], "template": []}
        for reference, places in zip(batch.column("reference").to_pylist(), batch.column("places").to_pylist(), strict=True):
            parents, labels = zip(*json.loads(reference), strict=True)
            mass, template, heads = [0.0] * len(parents), [], []
            for p in places:
                if p["constant"] is not None:
                    template.append({"place": p["place"], "text": p["constant"]})
                else:
                    mass[p["place"]] = float(max(0, p["chars"]))
                    if p["n"] >= LEAST and _tag(labels[p["place"]]) == "h1":
                        heads.append(p["place"])
            # of one main text alone nothing is known to vary
            several = max((p["n"] for p in places), default=0) > 1
            root, goes = _chosen_root(parents, labels, mass) if several and any(mass) else (-1, _NOTHING)
            out["root"].append(root)
            out["goes"].append(goes)
            out["heads"].append([] if goes == _NOTHING else sorted(heads))
            out["template"].append(template)
        kinds = {"root": pa.int32(), "goes": pa.int32(), "heads": pa.list_(pa.int32()), "template": pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64())]))}
        columns = [batch.column("host"), batch.column("reference"), *(pa.array(out[c], kind) for c, kind in kinds.items())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "reference", *kinds])


def _without_template(blocks: list[tuple[int, str]], page: Folded, constant: set[int], goes: int, roots: set[int]) -> list[str]:
    if goes == _NOTHING:
        return [line for _, line in blocks]
    varying = [k for k, (place, _) in enumerate(blocks) if place not in constant]
    if not varying:
        return []
    between = range(varying[0], varying[-1] + 1)

    def stays(k: int, place: int) -> bool:
        if place not in constant:
            return True
        of_body = _tag(page.labels[place]) in _HEADINGS and page.parents[place] in roots
        return k in between and (goes == _ENDS or of_body)

    return [line for k, (place, line) in enumerate(blocks) if stays(k, place)]


def _main_text(root: Node, page: Folded, to: list[int] | None, wrapper: dict) -> str:
    roots = {i for i, t in enumerate(to) if t == wrapper["root"]} if to is not None and wrapper["root"] >= 0 else set()
    lines: list[str] = []
    if roots:
        constants = {t["place"]: t["text"] for t in wrapper["template"]}
        # a place is template on the pages that have the constant text there, on others it is not
        constant = {i for i, t in enumerate(to) if t in constants and _hash("".join(page.texts[i])) == constants[t]}
        wanted = roots | {i for i, t in enumerate(to) if t in wrapper["heads"]}
        lines = _without_template(blocks_of(root, wanted), page, constant, wrapper["goes"], roots)
    return "\n".join(lines or [line for _, line in blocks_of(root, _own_root(page))])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, list[int]] = {}
    for batch in batches:
        out = []
        for row in batch.select(["_html", "reference", "root", "goes", "heads", "template"]).to_pylist():
            root, reference = parse(row["_html"] or ""), row["reference"]
            folded = fold(root)
            to = None
            if reference is not None:
                key = (folded.shape(), reference)
                to = known.get(key)
                if to is None:
                    if len(known) > _CACHE:
                        known.clear()
                    to = known[key] = align(key[0], tuple(map(tuple, json.loads(reference))))
            out.append(_main_text(root, folded, to, row))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out)], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (blocks parted by line feeds), n_chars."""
    pages = for_workers(pages).select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    pages = pages.withColumn("host", host_and_path(F.col("_url"))[0])
    wrapped = wrappers(pages).mapInArrow(_rooted, _ROOTED)
    both = pages.join(settle(wrapped), "host", "left")
    out = both.select("page_id", F.col("_url").alias("url"), "_html", "reference", "root", "goes", "heads", "template")
    return out.mapInArrow(_extracted, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
