"""Scalar operators as column expressions: vectors, geometry of sizes, paths and names, keys and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 6
# Extensions that are images, and those of raw camera files.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff")
RAW_EXTENSIONS = (
    "3fr ari arw bay crw cr2 cr3 cap data dcs dcr dng drf eip erf fff gpr iiq k25 kdc mdc mef mos mrw nef nrw obm orf pef ptx pxn r3d raf raw rwl rw2 rwz sr2 srf srw tif x3f"
).split()
#: Media types by extension.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "json": "application/json", "csv": "text/csv", "txt": "text/plain", "html": "text/html",
}
NO_MEDIA_TYPE = "application/octet-stream"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(value: Column | str, places: int) -> Column:
    """To decimal places as SQL engines round doubles: the nearest whole multiple (halves away from zero) of the product, divided again.
    ``F.round`` rounds the shortest decimal instead, which differs next to halves."""
    return F.round(_col(value) * float(10**places), 0) / float(10**places)


def sanitize(vec: str) -> Column:
    """A vector of single precision."""
    return F.col(vec).cast("array<float>")


def is_descriptor(vec: str, width: int = 64) -> Column:
    return F.coalesce(F.size(vec) == width, F.lit(False))


def linear_transform(vec: str, rows: list[list[float]], bias: list[float] | None = None) -> Column:
    """A matrix (its rows are literals) times the vector, and a bias."""
    out = [F.aggregate(F.zip_with(F.col(vec), F.array(*map(F.lit, r)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + (bias[i] if bias else 0.0) for i, r in enumerate(rows)]
    return F.array(*out)


def root_sift(vec: str) -> Column:
    """Root of the vector divided by the sum of its elements (and a little)."""
    total = F.aggregate(F.col(vec), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.col(vec), lambda x: F.sqrt(x / (total + 1e-8)))


def unpack_bits(values: str) -> Column:
    """Bits of bytes, the highest first."""
    return F.flatten(F.transform(F.col(values), lambda b: F.array(*(F.shiftright(b, k).bitwiseAND(1) for k in range(7, -1, -1)))))


def rotated_90(pw: str, ph: str, rw: str, rh: str, most: float = 25.0) -> Column:
    """1 if a result of size rw x rh looks like a probe of size pw x ph on its side: the inverse ratio is the closer one, and the size
    vectors, the result's turned, are at most ``most`` degrees apart."""
    p, r = _col(ph) / _col(pw), _col(rh) / _col(rw)
    turned = F.abs(p - r) > F.abs(p - 1 / r)
    norm = F.sqrt(_col(ph) ** 2 + _col(pw) ** 2) * F.sqrt(_col(rh) ** 2 + _col(rw) ** 2)
    inner = F.least(F.abs((_col(ph) * _col(rw) + _col(pw) * _col(rh)) / norm), F.lit(1.0))
    return F.when(turned & (F.degrees(F.acos(inner)) <= most), 1).otherwise(0).cast("long")


def fit_pixels(w: str, h: str, most: int) -> tuple[Column, Column]:
    """Width and height of the same ratio with ``most`` pixels, rounded half to even."""
    height = F.sqrt(_col(h) * float(most) / _col(w))
    return F.rint(height * _col(w) / _col(h)).cast("long"), F.rint(height).cast("long")


def cap_width(w: str, h: str, most: float = 512.0) -> tuple[Column, Column]:
    """Width and height, scaled down to a width of ``most`` and truncated, if wider."""
    scale = most / _col(w)
    smaller = scale < 1
    return F.when(smaller, (_col(w) * scale).cast("long")).otherwise(_col(w).cast("long")), F.when(smaller, (_col(h) * scale).cast("long")).otherwise(_col(h).cast("long"))


def cap_pixels(w: str, h: str, most: int = 2073600) -> tuple[Column, Column]:
    """Width and height, scaled down to ``most`` pixels if there are more; the height follows from the rounded width."""
    ratio = _col(h) / _col(w)
    width = F.rint(F.sqrt(most / ratio))
    more = _col(w) * _col(h) > most
    return F.when(more, width).otherwise(_col(w)).cast("long"), F.when(more, F.rint(ratio * width)).otherwise(_col(h)).cast("long")


def basename(path: str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: str) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def stem(path: str) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def is_image(path: str) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_raw(path: str) -> Column:
    """By extension as written, without regard to later ones of web formats."""
    own = F.regexp_extract(basename(path), r"\.([^.]+)$", 1)
    return own.isin(*RAW_EXTENSIONS)


def media_type(path: str) -> Column:
    out = F.lit(NO_MEDIA_TYPE)
    for name, kind in MEDIA_TYPES.items():
        out = F.when(extension(path) == name, kind).otherwise(out)
    return out


def index_key(key: str) -> dict[str, Column]:
    """Parts of keys like ``OPQ32_96,IVF1024,PQ32``: transform, lists, encoding; transform is empty if there is none."""
    pattern = r"^(?:((?:OPQ[0-9]+(?:_[0-9]+)?|PCAR[0-9]+)),)?(?:IVF([0-9]+)),(PQ[0-9]+|Flat)$"
    part = lambda i: F.regexp_extract(_col(key), pattern, i)
    return {"transform": part(1), "lists": part(2).try_cast("long"), "encoding": part(3)}


def vectors_in_memory(gigabytes: str, dims: int, float16: bool) -> Column:
    """How many vectors fit."""
    return F.floor(_col(gigabytes) * 1073741824.0 / (dims * (2 if float16 else 4))).cast("long")


def rescaled(x: str, scale: str) -> Column:
    return F.round(_col(x) * _col(scale), PLACES)


def job_of(position: str, n: Column, jobs: int) -> Column:
    """The job (from 0) of a row at ``position`` of ``n``: equal slices in order, the first ones taking what is left over."""
    size, more = F.floor(n / jobs), n % jobs
    edge = more * (size + 1)
    p = _col(position)
    return F.when(p < edge, F.floor(p / (size + 1))).otherwise(more + F.floor((p - edge) / F.greatest(size, F.lit(1)))).cast("long")
