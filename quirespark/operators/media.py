"""Images, of which only facts are read, and formats that are refused."""

from __future__ import annotations

import io

from quirespark.functions import markdown as md
from quirespark.functions.safety import safe_filename
from quirespark.operators.chain import Source, reads
from quirespark.schemas import Document, Options

Size = tuple[int | None, int | None]
_TYPES = {"jpg": "jpeg", "tif": "tiff", "ico": "x-icon"}


def dimensions(head: bytes) -> Size:
    """(width, height) from the header of a PNG, GIF or BMP."""
    for mark, at, size, order in ((b"\x89PNG\r\n\x1a\n", 16, 4, "big"), (b"GIF8", 6, 2, "little"), (b"BM", 18, 4, "little")):
        if head.startswith(mark) and len(head) >= at + 2 * size:
            return int.from_bytes(head[at : at + size], order), int.from_bytes(head[at + size : at + 2 * size], order)
    return None, None


@reads("image/image-metadata", 50, "size and place; no text recognition")
def read_image(source: Source, options: Options) -> Document:
    doc, facts = Document(), [("File", source.name), ("Bytes", f"{len(source.raw):,}")]
    width, height = dimensions(source.raw[:64])
    try:
        from PIL import ExifTags, Image

        with Image.open(io.BytesIO(source.raw)) as img:
            width, height = img.size
            facts += zip(("Format", "Mode"), (img.format or "", img.mode))
            exif = img.getexif()
            facts += [(ExifTags.TAGS[t], str(exif[t])) for t in (271, 272, 306, 274) if exif.get(t)]
    except ImportError:
        doc.info("pillow-missing", "only what the header says is known")
    except OSError as e:
        doc.flag("image-read-failed", str(e))
    if width:
        facts.insert(2, ("Dimensions", " x ".join(map(str, (width, height)))))
    doc.add("> **Not transcribed.** No text was recognised in it.")
    doc.facts(facts, key_header="Property")
    name, ext = safe_filename(source.name), source.ext[1:]
    doc.asset(name, source.raw, f"image/{_TYPES.get(ext, ext)}" if ext else "application/octet-stream", source.name)
    doc.add(md.image(source.name, f"assets/{name}"))
    doc.meta |= {"bytes": len(source.raw), "height": height, "width": width}
    doc.flag("image-not-transcribed", "text inside the image is not in the output")
    return doc


REFUSALS = {
    "binary": ("unsupported_binary", "binary file", "A binary file has no text; extract it first if it is a container."),
    "parquet": ("unsupported_parquet", "Parquet", "A Parquet table can be read directly, with spark.read.parquet."),
    "media": ("unsupported_media", "audio/video", "Sound and video need a transcript, which can be converted."),
    "unknown": ("unsupported_format", "unknown format", "The format is not known; it can be forced."),
}


def _refuse(key: str, name: str, title: str, hint: str) -> None:
    @reads(f"{key}/{name}-unsupported", 10, f"refuses a {title}")
    def read(source: Source, options: Options) -> Document:
        doc = Document()
        doc.heading(1, f"Unsupported: {source.name}")
        doc.add(md.blockquote(f"**{title}** — {hint}"))
        doc.meta["unsupported_kind"] = title
        return doc.fail("empty", "unsupported-format", ": ".join((title, hint)))


for _name, (_key, _title, _hint) in REFUSALS.items():
    _refuse(_key, _name, _title, _hint)
