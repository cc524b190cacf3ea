"""Text functions as column expressions: file-name patterns, label keys, identifiers, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns of the file-name conventions, first match wins.
SOURCE_PATTERNS = (
    ("numericid-WORD", r"(?i)^\d+-.+\.mp4$"),
    ("word_timestamp_n", r"(?i)^.+_\d{8}_\d{6}_\d+\.mp4$"),
    ("word_video_n", r"(?i)^.+_video_\d+\.mp4$"),
    ("word_n", r"(?i)^.+_\d+\.mp4$"),
    ("word_only", r"(?i)^[^_\d]+\.mp4$"),
)
# Shapes of identifiers and messages of the mailbox.
ROOM_ID = r"^[a-zA-Z0-9_-]{1,64}$"
CLIENT_ID = r"(?i)^[a-f0-9-]{36}$"
ROOM_LINK = r"^(?:https?://[^/]+)?/?channel/([a-zA-Z0-9_-]{1,64})/?(?:[?#].*)?$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
SIGNAL_TYPES = ("offer", "answer", "ice", "leave")
MAX_PAYLOAD_BYTES = 64_000


def first_match(value: Column, patterns, default: str = "other") -> Column:
    """Name of the first pattern that matches value."""
    out = None
    for name, pattern in patterns:
        hit = value.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def source_proxy(filename: Column) -> Column:
    return first_match(filename, SOURCE_PATTERNS)


def trim_space(x: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def label_key(x: Column) -> Column:
    """Key under which labels that differ by case and separators are equal."""
    return F.regexp_replace(F.lower(trim_space(x)), r"(?U)[\s_\-]+", "")


def tie_break(x: Column, seed: int) -> Column:
    """Seeded order that does not depend on input order: SHA-256 of "seed:x"."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), x.cast("string")), 256)


def array_name(sample_id: Column) -> Column:
    return F.concat(F.left(F.sha1(sample_id), F.lit(20)), F.lit(".npz"))


def augmentation_source(filename: Column, word: Column) -> Column:
    """File that an augmented copy (<source>_<word>_aug_<n>.mp4) was made from, else null."""
    stem = F.regexp_replace(filename, r"(?i)_aug_\d+\.mp4$", "")
    tail = F.concat(F.lit("_"), word)
    ends = F.lower(F.right(stem, F.length(tail))) == F.lower(tail)
    cut = F.when(ends, F.left(stem, F.length(stem) - F.length(tail))).otherwise(stem)
    return F.when(filename.rlike(r"(?i)_aug_\d+\.mp4$"), F.concat(cut, F.lit(".mp4")))


def after_first_slash(path: Column) -> Column:
    """What follows the first slash; null where there is none."""
    return F.when(path.contains("/"), F.substring(path, F.instr(path, "/") + 1, F.length(path)))


def batch_id(filename: Column, proxy: Column) -> Column:
    """Recording batch of a file, known for one naming convention only."""
    got = F.regexp_extract(filename, r"^(.*_\d{8}_\d{6})_\d+\.mp4$", 1)
    return F.when((proxy == "word_timestamp_n") & (got != ""), got)


def extension(filename: Column) -> Column:
    return F.lower(F.substring_index(filename, ".", -1))


def label_type(word: Column) -> Column:
    return (
        F.when(word.rlike(r"(?U)^\p{L}$"), "fingerspelled_letter")
        .when(word.rlike(r"(?U)\d"), "contains_digit")
        .when(word.rlike("[ _]"), "multi_word")
        .otherwise("single_word")
    )


def url_path(path: Column) -> Column:
    """Percent-encoded path: segments are quoted, slashes stay."""
    quoted = F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    return F.array_join(quoted, "/")


def valid_ids(room: Column, client: Column) -> Column:
    return room.rlike(ROOM_ID) & client.rlike(CLIENT_ID)


def signal_error(room: Column, sender: Column, receiver: Column, kind: Column, payload: Column) -> Column:
    """First error of a message, null if it is valid."""
    bad = ~valid_ids(room, sender) | ~receiver.rlike(CLIENT_ID) | (sender == receiver)
    return (
        F.when(F.coalesce(bad, F.lit(True)), "invalid_id")
        .when(~F.coalesce(kind.isin(*SIGNAL_TYPES), F.lit(False)), "invalid_type")
        .when(F.octet_length(payload) > MAX_PAYLOAD_BYTES, "too_large")
    )


def room_from_link(entry: Column) -> Column:
    """Room id of an id or a room link, else null."""
    entry = trim_space(entry)
    name = F.regexp_extract(entry, ROOM_LINK, 1)
    name = F.when(name != "", name).otherwise(entry)
    return F.when(name.rlike(ROOM_ID), name)


def registration_error(name: Column, email: Column, password: Column) -> Column:
    """First error of a registration, null if it is valid."""
    name, email = trim_space(F.coalesce(name, F.lit(""))), F.lower(trim_space(F.coalesce(email, F.lit(""))))
    size = F.length(F.coalesce(password, F.lit("")))
    return (
        F.when(~F.length(name).between(2, 80) | ~email.rlike(EMAIL), "invalid_name_or_email")
        .when(~size.between(8, 72), "invalid_password")
    )


def clock(seconds: Column) -> Column:
    """Seconds as mm:ss, both padded to two digits; minutes may grow longer."""
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.length(minutes), F.lit(2)), "0"), F.lit(":"), F.lpad(F.floor(F.pmod(seconds, F.lit(60))).cast("string"), 2, "0"))
