"""Image ingest and resizing. Decoding needs an imaging library, which is imported in the workers only."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry, scalars
from ..sources.readers import store

STATUS = "status string, src_name string, dst_name string, w int, h int, message string"


def header(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP, JPEG, WebP, TIFF or HEIF image."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return _webp(content)
    if content[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(content, "<" if content[:1] == b"I" else ">")
    if content[4:8] == b"ftyp":
        return _heif(content)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            mark = content[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD9:
                at += 1 if mark == 0xFF else 2
                continue
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return None


def _webp(content: bytes) -> tuple[int, int] | None:
    kind, at = content[12:16], 20
    if kind == b"VP8X" and len(content) >= at + 10:
        return 1 + int.from_bytes(content[at + 4 : at + 7], "little"), 1 + int.from_bytes(content[at + 7 : at + 10], "little")
    if kind == b"VP8L" and content[at : at + 1] == b"\x2f" and len(content) >= at + 5:
        bits = int.from_bytes(content[at + 1 : at + 5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and content[at + 3 : at + 6] == b"\x9d\x01\x2a" and len(content) >= at + 10:
        w, h = struct.unpack("<HH", content[at + 6 : at + 10])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _tiff(content: bytes, order: str) -> tuple[int, int] | None:
    """The first directory's width (tag 256) and height (257), as short or long."""
    if len(content) < 8:
        return None
    (at,) = struct.unpack(order + "I", content[4:8])
    if at + 2 > len(content):
        return None
    found = {}
    for i in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        entry = content[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            break
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = struct.unpack(order + "HI"[kind - 3], entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def _heif(content: bytes) -> tuple[int, int] | None:
    """The largest of the image sizes among the properties; tiles and thumbnails have smaller ones."""
    best, at = None, content.find(b"ispe")
    while at >= 0 and at + 16 <= len(content):
        size = struct.unpack(">II", content[at + 8 : at + 16])
        best = max(best or size, size, key=lambda x: x[0] * x[1])
        at = content.find(b"ispe", at + 4)
    return best


def dimensions(images: DataFrame) -> DataFrame:
    """(name, w, h) of images with their content; null where the header can't be read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            d = [header(bytes(c)) or (None, None) for c in pdf["content"]]
            yield pd.DataFrame({"name": pdf["name"], "w": pd.array([x[0] for x in d], "Int32"), "h": pd.array([x[1] for x in d], "Int32")})

    return images.select("name", "content").mapInPandas(read, "name string, w int, h int")


class Ranges:
    """The bytes of an open file, of which only the blocks that are looked at are read."""

    BLOCK = 1 << 14

    def __init__(self, file):
        self.file, self.size, self.blocks = file, file.size(), {}

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = bytes(self.file.read_at(self.BLOCK, k * self.BLOCK))
        return self.blocks[k]

    def __getitem__(self, at: int | slice):
        low, high, _ = at.indices(self.size) if isinstance(at, slice) else (at, at + 1, 1)
        first = low // self.BLOCK
        some = b"".join(self._block(k) for k in range(first, -(-high // self.BLOCK)))[low - first * self.BLOCK : high - first * self.BLOCK]
        return some if isinstance(at, slice) else some[0]

    def find(self, what: bytes, start: int = 0) -> int:
        while start < self.size:
            at = self[start : start + self.BLOCK].find(what)
            if at >= 0:
                return start + at
            start += max(1, self.BLOCK - len(what) + 1)
        return -1


def sized(images: DataFrame) -> DataFrame:
    """The images with w and h, by their path in a store that all tasks reach: files are opened by range, and what is read of each is what its header takes;
    null where it can't be read."""

    def size(path: str) -> tuple[int | None, int | None]:
        try:
            files, name = store(path)
            with files.open_input_file(name) as f:
                return header(Ranges(f)) or (None, None)
        except (OSError, ValueError, struct.error):
            return None, None

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            d = [size(p) for p in pdf["path"]]
            yield pdf.assign(w=pd.array([x[0] for x in d], "Int32"), h=pd.array([x[1] for x in d], "Int32"))

    return images.mapInPandas(read, ", ".join([*(f"`{c}` {t}" for c, t in images.dtypes), "w int, h int"]))


def dimensions_at(images: DataFrame) -> DataFrame:
    """(path, w, h) of images (``sized``)."""
    return sized(images.select("path"))


def number(images: DataFrame, ok: str = "ok") -> DataFrame:
    """image_id of images (folder, name, ok): a number within the house by lower-cased name, over images that decode only."""
    house = scalars.house_from_folder(F.col("folder"))
    good = images.where(ok).withColumn("house_id", house).where("house_id is not null")
    n = F.row_number().over(Window.partitionBy("house_id").orderBy(F.lower("name"), "name"))
    return good.withColumn("image_id", scalars.sequence_id(F.col("house_id"), n))


def manifest(numbered: DataFrame) -> DataFrame:
    """Manifest rows of numbered images (w, h: original size)."""
    plan = geometry.long_edge_plan(F.col("w"), F.col("h"))
    return numbered.select(
        "image_id", "house_id", F.col("name").alias("original_filename"), F.concat_ws("/", "folder", "name").alias("original_relpath"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("original_format"),
        F.col("w").alias("orig_width"), F.col("h").alias("orig_height"), plan["w"].alias("final_width"), plan["h"].alias("final_height"), scalars.orientation(plan["w"], plan["h"]).alias("orientation"),
    )


def duplicate_stems(names: DataFrame) -> DataFrame:
    """(first, later) of files whose outputs would have one name."""
    w = Window.partitionBy("_stem").orderBy("name")
    n = names.select("name", scalars.stem(F.col("name")).alias("_stem")).withColumns({"first": F.first("name").over(w), "_n": F.row_number().over(w)})
    return n.where("_n > 1").select("first", F.col("name").alias("later"))


def jobs(sources: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Sources whose output is not there yet."""
    named = sources.withColumn("dst_name", scalars.flat_image_file(F.col("name"), ".jpg"))
    return named if force else named.join(outputs.select(F.col("name").alias("dst_name")), "dst_name", "left_anti")


def pillow_resize(content: bytes, side: int, quality: int) -> tuple[bytes, int, int]:
    import io

    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(content)) as im:
        im = ImageOps.exif_transpose(im).convert("RGB")
        w, h = im.size
        if min(w, h) > side:
            w, h = (side, max(1, round(h * side / w))) if w <= h else (max(1, round(w * side / h)), side)
            im = im.resize((w, h), Image.LANCZOS)
        out = io.BytesIO()
        im.save(out, format="JPEG", quality=quality, optimize=True)
        return out.getvalue(), w, h


def pillow_ingest(content: bytes, edge: int, quality: int) -> tuple[bytes, int, int]:
    import io

    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(content)) as im:
        im = ImageOps.exif_transpose(im).convert("RGB")
        im.thumbnail((edge, edge), Image.LANCZOS)
        out = io.BytesIO()
        im.save(out, format="JPEG", quality=quality, optimize=True)
        return out.getvalue(), *im.size


def ingest(numbered: DataFrame, edge: int = vocab.LONG_EDGE_PX, quality: int = vocab.INGEST_QUALITY, work: Callable[[bytes, int, int], tuple[bytes, int, int]] = pillow_ingest) -> DataFrame:
    """Status rows with the upright, capped JPEG content of numbered images, named by house and image_id; ``writers.images`` writes them."""
    return resize(numbered.withColumn("dst_name", F.concat("house_id", F.lit("/"), "image_id", F.lit(".jpg"))), edge, quality, work)


def resize(images: DataFrame, side: int = vocab.SHORT_SIDE_PX, quality: int = vocab.RESIZE_QUALITY, work: Callable[[bytes, int, int], tuple[bytes, int, int]] = pillow_resize) -> DataFrame:
    """Status rows with the resized content; a failure is a row, never an exception."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for name, dst, content in zip(pdf["name"], pdf["dst_name"], pdf["content"]):
                try:
                    made, w, h = work(bytes(content), side, quality)
                    out.append(("done", name, dst, w, h, None, made))
                except Exception as e:  # noqa: BLE001
                    out.append(("failed", name, dst, None, None, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=["status", "src_name", "dst_name", "w", "h", "message", "content"]).astype({"w": "Int32", "h": "Int32"})

    return images.select("name", "dst_name", "content").mapInPandas(run, f"{STATUS}, content binary")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def short_sides(sizes: DataFrame, side: int = vocab.SHORT_SIDE_PX) -> DataFrame:
    low = F.least("w", "h")
    return sizes.agg(F.count_if(low == side).alias("exact"), F.count_if(low < side).alias("smaller"), F.count_if(low > side).alias("oversized"))


def verdict(files: DataFrame, expected: int = vocab.EXPECTED_IMAGES) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files")).withColumn("ok", F.col("files") == expected)
