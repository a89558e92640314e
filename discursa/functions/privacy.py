"""Pseudonyms for account names and @mentions, as JVM-side expressions."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from discursa import config
from discursa.functions.text import strip


def load_salt(path: str) -> bytes:
    """Salt of the releases: read from a private file, created on first use.

    Runs on the driver only; the salt reaches the executors as a literal and must
    never be written next to released data.
    """
    if os.path.exists(path):
        with open(path, encoding="ascii") as handle:
            return bytes.fromhex(handle.read().strip())
    salt = secrets.token_bytes(16)
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(handle, "w", encoding="ascii") as out:
        out.write(salt.hex())
    return salt


def pseudonym(name: Column, salt: bytes) -> Column:
    """First 12 hex digits of SHA-256(salt, trimmed lower-case name); placeholders pass through."""
    key = F.lower(strip(name))
    digest = F.sha2(F.concat(F.lit(salt), key.cast("binary")), 256)
    return F.when(key.isin(config.ACCOUNT_SENTINELS), name).otherwise(F.substring(digest, 1, 12))


def mentions(text: Column, salt: bytes) -> Column:
    """Pseudonyms of the accounts mentioned in a text, in order."""
    handles = F.regexp_extract_all(text, F.lit(config.MENTION_PATTERN), F.lit(1))
    return F.transform(handles, lambda h: pseudonym(F.rtrim(h, F.lit(".")), salt))


def mask_mentions(text: Column, salt: bytes) -> Column:
    """Replace every @mention by @pseudonym; dots at the end of a handle are dropped."""
    pieces = F.split(text, config.MENTION_PATTERN, -1)
    heads = F.transform(mentions(text, salt), lambda p: F.concat(F.lit("@"), p))
    # pieces is always one longer than heads: p0 h0 p1 h1 ... pn
    woven = F.zip_with(
        pieces, heads, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))
    )
    return F.when(text.contains("@"), F.array_join(woven, "")).otherwise(text)
