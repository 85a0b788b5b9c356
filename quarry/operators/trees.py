"""Document trees in JSON: images replaced by what was recognised in them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def with_replacements(node, found: dict[str, tuple[str, str]]):
    """A tree with its images replaced: by a raw Markdown block where a table was found, else with the caption as its text."""
    if isinstance(node, list):
        return [with_replacements(x, found) for x in node]
    if not isinstance(node, dict):
        return node
    content = node.get("c")
    if node.get("t") == "Image" and isinstance(content, list) and len(content) > 2:
        target = content[2]
        kind, text = found.get(target[0] if isinstance(target, list) and target else str(target), ("", ""))
        if kind == "table":
            return {"t": "RawBlock", "c": ["markdown", text]}
        if kind:
            return {**node, "c": [content[0], [{"t": "Str", "c": text}], *content[2:]]}
    return {k: with_replacements(v, found) for k, v in node.items()}


def replaced_images(tree: Column, found: Column) -> Column:
    """The tree as JSON; found: map of an image's source to struct<kind, content> (kind table, text or diagram).  What is no JSON stays as it is, and so does a tree without anything found."""

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for trees, maps in frames:
            out = []
            for text, pairs in zip(trees, maps):
                known = {p["key"]: (p["value"]["kind"], p["value"]["content"]) for p in json.loads(pairs)} if pairs else {}
                try:
                    out.append(json.dumps(with_replacements(json.loads(text), known), ensure_ascii=False) if text and known else text)
                except (json.JSONDecodeError, RecursionError):
                    out.append(text)
            yield pd.Series(out, dtype=object)

    # maps cross as JSON text: their values are structs
    return F.pandas_udf(run, "string")(tree, F.when(F.size(found) > 0, F.to_json(F.map_entries(found))))
