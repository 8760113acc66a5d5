"""Documents from files: text of any encoding, EPUB, DOCX, glossary and relation tables, style profiles, progress.

Tasks list the folders and open the files where pyarrow reaches the store, so the driver holds nothing per file. Elsewhere files come
as rows of the ``binaryFile`` source, whose driver lists every file, so their number is bounded by its memory. One file is parsed by
one task. Names that begin with a dot or an underscore are no data. Formats without a parser in the standard library (PDF, scans) take
a function.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.layout import epub_paragraphs, text_map

#: Encodings of two bytes a character with the lead bytes of their most usual characters, as both lists sort those first, and the
#: least second byte of those.
WIDE = {"gb18030": (0xA1, 0xD7, 0xA1), "big5": (0xA1, 0xC6, 0x40)}
#: Below this confidence a text is read as UTF-8, bad bytes replaced.
CONFIDENT = 0.7
#: Files that a task reads before it hands on their rows, the bytes at which it does so sooner, and paths that it lists at a time.
READ_FILES, READ_BYTES, LISTED = 64, 8 << 20, 10_000
#: Standard column names of the dictionaries and the names they also go by.
GLOSSARY_COLUMNS = {
    "Original_Term_CN": ("Original_Term_CN", "Original_Term_Chinese", "Chinese", "CN"), "Original_Term_Pinyin": ("Original_Term_Pinyin", "Pinyin"), "Original_Term_EN": ("Original_Term_EN", "English", "EN", "Term"),
    "Translated_Term_VI": ("Translated_Term_VI", "Translation", "VI"), "Translated_Term_EN": ("Translated_Term_EN",), "Type": ("Type", "Category"), "Notes": ("Notes", "Note", "Translation_Notes"),
}
RELATION_COLUMNS = {"Speaker_ID": ("Speaker_ID", "Character_A", "Speaker"), "Listener_ID": ("Listener_ID", "Character_B", "Listener"), "Context": ("Context",), "Speaker_Pronoun": ("Speaker_Pronoun", "A_Self"), "Listener_Term": ("Listener_Term", "B_Self"), "Notes": ("Notes",), "Type": ("Type",), "Chapter_Range": ("Chapter_Range",)}


def detect(data: bytes) -> tuple[str, float]:
    """(encoding, confidence): a byte order mark, valid UTF-8, else the likeliest of WIDE and Windows-1252.

    For the wide ones confidence is the share of usual characters among all beyond ASCII, for Windows-1252 the share of letters
    and typographic marks beside letters or spaces among the high bytes.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name, 1.0
    try:
        data.decode()
        return "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    found = [(0.0, "utf-8")]
    for name, (low, high, second) in WIDE.items():
        try:
            wide = [c.encode(name) for c in data.decode(name) if c > "\x7f"]
        except UnicodeDecodeError:
            continue
        found.append((sum(len(b) == 2 and low <= b[0] <= high and b[1] >= second for b in wide) / max(1, len(wide)), name))
    try:
        text = data.decode("cp1252")
        high = [k for k, c in enumerate(text) if c > "\x7f"]
        alone = sum(text[k].isalpha() and not (k and text[k - 1] > "\x7f" and not text[k - 1].isalpha()) or text[k] in "‘’“”–—…€«»°§" for k in high)
        single = sum(not (k and text[k - 1] > "\x7f") for k in high)
        found.append((alone / max(1, len(high)) * min(1.0, 1.2 * single / max(1, len(high))), "cp1252"))
    except UnicodeDecodeError:
        pass
    confidence, name = max(found, key=lambda x: x[0])
    return name, confidence


def decode(data: bytes, forced: str | None = None) -> tuple[str, str]:
    """(text, encoding) by detect(), or in the ``forced`` encoding; bad bytes are replaced."""
    name, confidence = (forced, 1.0) if forced else detect(data)
    if confidence < CONFIDENT:
        name = "utf-8"
    return data.decode(name, "replace"), name


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Chapter files in reading order: the spine, else the manifest's pages, else all pages of the archive by name."""
    strip = lambda tag: tag.rpartition("}")[2]
    try:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in box.iter() if strip(e.tag) == "rootfile")
        tree = ElementTree.fromstring(z.read(opf))
    except (KeyError, StopIteration, ElementTree.ParseError):
        return sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
    items = {e.attrib["id"]: e.attrib for e in tree.iter() if strip(e.tag) == "item" and "href" in e.attrib}
    base = opf.rpartition("/")[0]
    names = [items[e.attrib["idref"]]["href"] for e in tree.iter() if strip(e.tag) == "itemref" and e.attrib.get("idref") in items]
    names = names or [i["href"] for i in items.values() if "html" in i.get("media-type", "") or i["href"].lower().endswith((".xhtml", ".html"))]
    return [posixpath.normpath(f"{base}/{unquote(n)}") if base else unquote(n) for n in names]


def epub_chapters(data: bytes) -> list[tuple[str, str]]:
    """(name, HTML) of the chapters there are; items that the archive lacks are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        return [(n, z.read(n).decode("utf-8", "ignore")) for n in _spine(z) if n in there]


def parse_epub(data: bytes) -> str:
    parts = ["\n\n".join(epub_paragraphs(page)) for _, page in epub_chapters(data)]
    return "\n\n".join(p for p in parts if p)


def parse_docx(data: bytes) -> str:
    """Paragraphs with text, trimmed, with an empty line between."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ["".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" for t in p.iter() if t.tag in (f"{w}t", f"{w}tab", f"{w}br")).strip() for p in tree.iter(f"{w}p")]
    return "\n\n".join(t for t in texts if t)


def _reached(spark: SparkSession, path: str) -> tuple[str, bool] | None:
    """The path of one file or folder in a store that pyarrow reaches, and whether it is a folder; None for patterns and other stores."""
    from pyarrow import fs

    if "://" not in path and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return None
    try:
        store, top = fs.FileSystem.from_uri(path)
        kind = store.get_file_info(top).type
    except (ValueError, OSError, NotImplementedError):
        return None
    return (top, kind == fs.FileType.Directory) if kind in (fs.FileType.File, fs.FileType.Directory) else None


def _inside(store, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, is a folder) of what lies right in a folder; of a local one it is streamed."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            found = ((e.path, e.is_dir()) for e in entries)
            yield from (x for x in found if not posixpath.basename(x[0]).startswith((".", "_")))
    else:
        found = ((e.path, e.type == fs.FileType.Directory) for e in store.get_file_info(fs.FileSelector(folder)))
        yield from (x for x in found if not posixpath.basename(x[0]).startswith((".", "_")))


def _listed(spark: SparkSession, path: str, top: str, folder: bool, suffix: str) -> DataFrame:
    """(path) of all files below ``top``, dealt to tasks. The folders right in it are listed by separate tasks, each to its depth."""

    def step(deep: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(path)
            out: list[tuple[str, bool]] = []
            for frame in frames:
                for found in zip(frame["path"], frame["folder"], strict=True):
                    todo = [found[0]] if found[1] else []
                    if not found[1]:
                        out.append(found)
                    while todo:
                        for x in _inside(store, todo.pop()):
                            if x[1] and deep:
                                todo.append(x[0])
                            elif x[1] or x[0].endswith(suffix):
                                out.append(x)
                            if len(out) >= LISTED:
                                yield pd.DataFrame(out, columns=["path", "folder"])
                                out = []
            if out:
                yield pd.DataFrame(out, columns=["path", "folder"])

        return run

    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(top, folder)], "path string, folder boolean")
    for deep in (False, True):
        rows = rows.mapInPandas(step(deep), rows.schema).repartition(tasks, "path")
    return rows.select("path")


def _read(spark: SparkSession, path: str, parse: Callable[[str, bytes], list[tuple]], schema: str, suffix: str = "") -> DataFrame:
    """Rows of ``parse`` of the path and bytes of each file below ``path`` whose name ends with ``suffix``."""
    names = [c.split()[0] for c in schema.split(", ")]
    reached = _reached(spark, path)
    bare = path.rstrip("/")
    prefix = "" if reached is None or not bare.endswith(reached[0]) else bare.removesuffix(reached[0]) or "file:"

    def contents(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        if reached is None:
            for frame in frames:
                yield from zip(frame["path"], frame["content"], strict=True)
            return
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        for frame in frames:
            for name in frame["path"]:
                with store.open_input_stream(name, compression=None) as f:
                    yield f"{prefix}{name}", f.read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        n = size = 0
        for name, data in contents(frames):
            rows += parse(name, data)
            n, size = n + 1, size + len(data)
            if n >= READ_FILES or size >= READ_BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, n, size = [], 0, 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    if reached is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")
    else:
        found = _listed(spark, path, *reached, suffix)
    return found.mapInPandas(run, schema)


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, format, text, encoding, error) of all files below ``path``; a file that fails to parse has an error and no text."""
    known: dict[str, Callable[[bytes], str]] = {"epub": parse_epub, "docx": parse_docx, **(parsers or {})}

    def parse(name: str, data: bytes) -> list[tuple]:
        kind = name.rpartition(".")[2].lower()
        try:
            if kind == "txt":
                text, encoding = decode(data)
            elif kind in known:
                text, encoding = known[kind](data), None
            else:
                raise ValueError(f"unsupported format: {kind}")
            return [(name, kind, text, encoding, None)]
        except Exception as e:  # noqa: BLE001  one bad file must not end the job; the row says what failed
            return [(name, kind, None, None, f"{type(e).__name__}: {e}")]

    return _read(spark, path, parse, "path string, format string, text string, encoding string, error string")


def read_epub_layout(spark: SparkSession, path: str) -> DataFrame:
    """(path, text_id, chapter_id, ord, text, inner_html, image_only): the text maps of all EPUB files below ``path``."""

    def parse(name: str, data: bytes) -> list[tuple]:
        rows = []
        for chapter, page in epub_chapters(data):
            stem = re.sub(r"\.[^.]*$", "", chapter.rpartition("/")[2])
            rows += [(name, e.text_id, e.chapter_id, e.order, e.text, e.inner, e.image_only) for e in text_map(page, stem)[0]]
        return rows

    return _read(spark, path, parse, "path string, text_id string, chapter_id string, ord int, text string, inner_html string, image_only boolean", ".epub")


def sniff_delimiter(spark: SparkSession, path: str, choices: str = ",;\t|") -> str:
    """The delimiter that stands most often in the first line of a file that has any; the first choice if none does."""
    heads = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    counts = [heads[0].value.count(c) for c in choices] if heads else [1]
    return choices[counts.index(max(counts))] if max(counts) else choices[0]


def read_dictionary(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]] = GLOSSARY_COLUMNS, sep: str | None = None) -> DataFrame:
    """A CSV of strings under standard column names; of a row's aliases the first that is not blank, blank where there is none.

    The delimiter is found from the header unless given; malformed rows go.
    """
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED", multiLine=True, escape='"', encoding="utf-8", sep=sep or sniff_delimiter(spark, path))
    clean = {c.lstrip("\ufeff").strip(): c for c in raw.columns}

    def first(names: tuple[str, ...]):
        return F.coalesce(*[F.nullif(F.trim(F.col(f"`{clean[a]}`")), F.lit("")) for a in names if a in clean], F.lit(""))

    return raw.select(*[first(names).alias(std) for std, names in columns.items()])


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, profile) of all JSON files below ``path`` as variants; a file that is no JSON has none."""
    texts = _read(spark, path, lambda name, data: [(name, data.decode("utf-8", "replace"))], "path string, value string")
    return texts.select("path", F.try_parse_json("value").alias("profile"))


def normalise_keys(value, aliases: dict[str, str]):
    """Nested JSON with keys renamed at every depth."""
    if isinstance(value, dict):
        return {aliases.get(k, k): normalise_keys(v, aliases) for k, v in value.items()}
    return [normalise_keys(v, aliases) for v in value] if isinstance(value, list) else value


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, text) of a folder with one text or gzip file per chunk, at any depth, or of a JSON file of completed chunks."""

    def parse(name: str, data: bytes) -> list[tuple]:
        data = gzip.decompress(data) if name.endswith(".gz") else bytes(data)
        if name.removesuffix(".gz").endswith(".json"):
            return [(int(k), v) for k, v in json.loads(data).get("completed_chunks", {}).items()]
        m = re.search(r"(\d+)\.txt(?:\.gz)?$", name)
        return [(int(m[1]), data.decode("utf-8", "replace"))] if m else []

    return _read(spark, path, parse, "chunk_id bigint, text string")
