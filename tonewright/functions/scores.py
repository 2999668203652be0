"""The quality model and the parts of the cluster key that are numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per codec; of lossy ones by the least bitrate in kbit/s.
LOSSLESS = {"flac": 45, "alac": 45, "ape": 38, "wavpack": 38, "wv": 38}
LOSSY = {
    "aac": ((320, 28), (256, 26), (192, 23), (128, 19), (0, 15)),
    "mp3": ((320, 22), (256, 20), (192, 17), (128, 13), (0, 8)),
    "opus": ((192, 27), (128, 25), (96, 21), (0, 17)),
    "vorbis": ((256, 24), (192, 21), (128, 18), (0, 14)),
    "wma": ((256, 20), (192, 17), (128, 14), (0, 10)),
}
OTHER_LOSSY = ((256, 16), (192, 14), (0, 10))
LOSSLESS_CODECS = ("flac", "alac", "ape", "wavpack", "wv", "tta", "pcm", "wav", "aiff")


def _ladder(value: Column, steps: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(float(steps[-1][1]))
    for least, points in reversed(steps[:-1]):
        out = F.when(value >= least, float(points)).otherwise(out)
    return out


def codec_score(codec: Column, lossless: Column, bitrate: Column) -> Column:
    c = F.lower(codec)
    plain = F.when(F.startswith(c, F.lit("pcm_")), 42.0).otherwise(35.0)
    for name, points in LOSSLESS.items():
        plain = F.when(c == name, float(points)).otherwise(plain)
    lossy = _ladder(bitrate, OTHER_LOSSY)
    for name, steps in LOSSY.items():
        lossy = F.when(c == name, _ladder(bitrate, steps)).otherwise(lossy)
    return F.when(lossless, plain).otherwise(lossy)


def bit_depth_score(depth: Column) -> Column:
    return F.when(depth >= 24, 5.0).when(depth >= 20, 3.0).when(depth >= 16, 0.0).otherwise(-2.0)


def sample_rate_score(rate: Column) -> Column:
    return F.when(rate >= 96000, 5.0).when(rate >= 48000, 2.0).when(rate >= 44100, 0.0).when(rate >= 32000, -1.0).otherwise(-3.0)


def tag_score(artist: Column, album: Column, title: Column, track: Column) -> Column:
    n = (artist != "").cast("int") + (album != "").cast("int") + (title != "").cast("int") + (track > 0).cast("int")
    return (n + (n >= 4).cast("int")).cast("double")


def size_score(lossless: Column, size: Column) -> Column:
    return F.when(lossless & (size > 50 * 1048576), 2.0).when(lossless & (size > 20 * 1048576), 1.0).otherwise(0.0)


def quality_score(c: dict[str, Column]) -> Column:
    return codec_score(c["codec"], c["lossless"], c["bitrate_kbps"]) + bit_depth_score(c["bit_depth"]) + sample_rate_score(c["sample_rate"]) + F.when(c["lossless"], 10.0).otherwise(0.0) + tag_score(c["tag_artist"], c["tag_album"], c["tag_title"], c["tag_track"]) + size_score(c["lossless"], c["size_bytes"])


def proximity_score(gap_ms: Column) -> Column:
    return F.when(gap_ms <= 1500, 6.0).when(gap_ms <= 3000, 3.0).when(gap_ms <= 5000, 1.0).otherwise(-2.0)


def duration_delta(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def duration_bucket(ms: Column) -> Column:
    """Seconds to the nearest multiple of three, 0 for none."""
    return F.when(ms <= 0, 0).otherwise(F.round(ms / F.lit(3000.0)) * 3).cast("int")


def is_lossless(codec: Column) -> Column:
    return F.lower(codec).isin(*LOSSLESS_CODECS) | F.startswith(F.lower(codec), F.lit("pcm_"))
