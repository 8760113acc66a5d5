"""Results to files: chunks, progress, residual sentences, dictionaries, HTML.

Writers are Spark's own, whose committers make a result appear as a whole or not at all. Where a result is one file per
row, tasks write each file beside its name and rename it, so a reader never meets half of one, and a task that runs
again writes the same files.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(results: DataFrame, key: str = "chunk_id", order: str = "ts", status: str = "status") -> DataFrame:
    """The last write of each chunk; a success goes before any partial result."""
    rank = F.row_number().over(W.partitionBy(key).orderBy((F.col(status) == "success").desc(), F.col(order).desc()))
    return results.withColumn("_k", rank).where("_k = 1").drop("_k")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Texts by document, long documents' rows spread over files by Spark."""
    chunks.write.mode(mode).option("compression", "zstd").partitionBy("source").parquet(path)


def write_files(files: DataFrame, folder: str, make: Callable[..., tuple[str, bytes]]) -> DataFrame:
    """One file below ``folder`` per row: ``make`` gives its name and bytes from the row's columns. A lazy (path, bytes) per file.

    ``folder`` is in any store that pyarrow reaches and all executors share.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        attempt, there = TaskContext.get().taskAttemptId(), set()
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False, name=None):
                name, data = make(*row)
                path = posixpath.join(top, name)
                if (parent := posixpath.dirname(path)) not in there:
                    store.create_dir(parent, recursive=True)
                    there.add(parent)
                # Names that begin with a dot or an underscore are no data to Spark's readers.
                part = posixpath.join(parent, f".{posixpath.basename(path)}.{attempt}")
                with store.open_output_stream(part, compression=None) as out:
                    out.write(data)
                store.move(part, path)
                done.append((path, len(data)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return files.mapInPandas(run, "path string, bytes bigint")


def chunk_file(chunk_id: int, text: str, gzip_over: int = 5000) -> tuple[str, bytes]:
    """Name and bytes of a chunk's file, packed if the text has over ``gzip_over`` characters."""
    data = text.encode()
    return (f"chunk_{chunk_id}.txt.gz", gzip.compress(data, mtime=0)) if len(text) > gzip_over else (f"chunk_{chunk_id}.txt", data)


def docx_file(name: str, text: str) -> tuple[str, bytes]:
    """Name and bytes of a DOCX file with a paragraph for each one of the text; empty lines part them."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p, quote=False)}</w:t></w:r></w:p>' for p in text.split("\n\n"))
    kinds = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    return f"{name}.docx", _zip({"[Content_Types].xml": kinds, "_rels/.rels": rels, "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})


def epub_file(name: str, title: str, chapters: list[str]) -> tuple[str, bytes]:
    """Name and bytes of an EPUB whose spine has the bodies of ``chapters`` (XHTML) in order."""
    page = lambda body: f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{body}</body></html>'
    names = [f"c{k:04d}" for k in range(len(chapters))]
    items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    opf = f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(name)}</dc:identifier><dc:title>{escape(title)}</dc:title></metadata><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in names)}</spine></package>'
    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return f"{name}.epub", _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": box, "OEBPS/content.opf": opf, **{f"OEBPS/{n}.xhtml": page(c) for n, c in zip(names, chapters, strict=True)}})


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_text(rows: DataFrame, path: str, text: str = "text") -> None:
    """Texts as lines, one file a task."""
    rows.select(F.col(text).cast("string")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines stamped with the time of writing; earlier exports stay."""
    metrics.withColumn("exported_at", F.current_timestamp()).write.mode("append").json(path)


def export_metrics(events: DataFrame, path: str, interval: str, summary: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Writes ``summary`` of each interval's events of a stream as JSON; the running query."""
    return events.writeStream.foreachBatch(lambda batch, _: write_metrics(summary(batch), path)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def append_residuals(sentences: DataFrame, path: str) -> None:
    sentences.write.mode("append").json(path)


def write_progress(progress: DataFrame, path: str) -> None:
    progress.write.mode("overwrite").json(path)


def write_dictionary(rows: DataFrame, path: str, header: list[str]) -> None:
    """A CSV with a fixed header: further columns are left out, missing ones are blank."""
    there = set(rows.columns)
    rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in there else F.lit("").alias(c) for c in header]).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_paragraph(c: Column) -> Column:
    """Escaped text as a paragraph; an empty line ends it, a line end is a break."""
    c = F.replace(F.replace(escape_html(c), F.lit("\n\n"), F.lit("</p><p>")), F.lit("\n"), F.lit("<br>"))
    return F.concat(F.lit("<p>"), c, F.lit("</p>"))


def html_master(chapters: DataFrame, key: str, order: str, body: str, title: Column) -> DataFrame:
    """One page per ``key``: a section for each chapter in order, image sources reduced to their names."""
    section = F.concat(F.lit("<section>"), F.regexp_replace(F.col(body), r'src="(?:[^"]*/)?([^"/]+)"', 'src="$1"'), F.lit("</section>"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), section.alias("s")))), lambda x: x["s"])
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), F.first(escape_html(title)), F.lit('</title></head><body><main id="nt-content">'), F.array_join(parts, ""), F.lit("</main></body></html>"))
    return chapters.groupBy(key).agg(page.alias("html"))
