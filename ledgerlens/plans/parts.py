"""The report in parts: for collections that neither the driver nor one file holds.

    header.json     what the report says beside its objects
    objects/        JSON lines, an object each, in the report's order by file name
    pages/          HTML pages of ``PAGE`` objects with the header's figures
    index.html      the first page's figures and a line for each page
    footer.json     how many objects and pages there are; written last

Tasks write objects and pages; the driver holds the header and a row a page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..numbering import numbered
from ..operators.rules import cited
from ..sources.lists import Config
from .html import TEMPLATE, render
from .screening import Screening, header

#: Objects on a page.
PAGE = 500


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that workers and driver reach alike, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, text: str) -> None:
    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(text.encode())


def flag_json(f: Column, citation: bool) -> Column:
    last = ("entry_type", F.get_json_object(f["cited_fields"], "$.aliu_entry_type")) if citation else ("presumption_tier", f["presumption_tier"], True)
    return cited(*[(n, f[n]) for n in ("rule_id", "rule_statement", "methodology")], ("cited_fields", f["cited_fields"], "json"), last, ("llm_explanation", F.lit(None).cast("string")))


def object_json(objects: DataFrame) -> Column:
    """An object's result as the report has it."""

    def listed(name: str, citation: bool = False) -> Column:
        flags = F.transform(F.col(name), lambda f: flag_json(f, citation)) if objects.schema[name].dataType.typeName() == "array" else F.lit(None)
        return F.concat(F.lit("["), F.coalesce(F.array_join(flags, ","), F.lit("")), F.lit("]"))

    plain = [(n, F.col(n)) for n in ("object_id", "object_title", "object_class", "screening_statement", "resolved_status", "coverage_note")]
    axes = [(n, listed(n), "json") for n in ("persecution_context_flags", "documentation_quality_flags")]
    return cited(*plain, *axes, ("name_list_citations", listed("name_list_citations", True), "json"))


def write_parts(screening: Screening, cfg: Config, folder: str, input_file: str, input_format: str, ingest_notes: list[dict], margin: int, page: int = PAGE) -> dict:
    """The footer; explanations are a table of their own (``explained``)."""
    folder = folder.rstrip("/")
    top = header(screening, cfg, input_file, input_format, ingest_notes, margin)
    put(f"{folder}/header.json", json.dumps(top, ensure_ascii=False))
    rows = numbered(screening.objects.select("chain_seq", "object_id", object_json(screening.objects).alias("value")), "chain_seq", "object_id")
    rows.orderBy("number").select("value").write.mode("overwrite").text(f"{folder}/objects")
    small, template = {**top, "ingest_notes": []}, TEMPLATE.read_text(encoding="utf-8")
    n = top["coverage_map"]["objects_processed"]
    pages = max(1, -(-n // page))

    def print_page(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("number")
        k = int(batch["number"].iloc[0]) // page
        put(f"{folder}/pages/{name(k)}", render(small | {"objects": [json.loads(v) for v in batch["value"]], "page": k, "pages": pages}, text=template))
        return pd.DataFrame([(k, batch["object_id"].iloc[0], batch["object_id"].iloc[-1], len(batch))], columns=["page", "first", "last", "n"])

    printed = rows.withColumn("page", F.floor(F.col("number") / page)).groupBy("page").applyInPandas(print_page, "page long, first string, last string, n long")
    index = [r.asDict() | {"file": f"pages/{name(r.page)}"} for r in sorted(printed.collect(), key=lambda r: r.page)]
    put(f"{folder}/index.html", render(top | {"objects": [], "index": index}, text=template))
    footer = {"objects": n, "pages": len(index), "objects_on_a_page": page}
    put(f"{folder}/footer.json", json.dumps(footer))
    return footer


def name(page: int) -> str:
    return f"page-{page:07}.html"


def object_lines(folder: str) -> Iterator[str]:
    """The objects of a report in parts, one at a time and in order."""
    system, path = located(f"{folder.rstrip('/')}/objects")
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
    for file in files:
        with system.open_input_file(file) as f:
            yield from _lines(f)


def _lines(f) -> Iterator[str]:
    rest = b""
    while block := f.read(1 << 24):
        *lines, rest = (rest + block).split(b"\n")
        yield from (line.decode() for line in lines)
    if rest:
        yield rest.decode()


def joined(folder: str) -> Iterator[str]:
    """The report as one JSON text, piece by piece."""
    system, path = located(f"{folder.rstrip('/')}/header.json")
    with system.open_input_stream(path) as f:
        yield f.read().decode().rstrip()[:-1] + ', "objects": ['
    for k, line in enumerate(object_lines(folder)):
        yield ("," if k else "") + line
    yield "]}"
