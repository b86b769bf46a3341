"""AES-256-GCM on columns; layout nonce, text, tag; a context is authenticated with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt(plain: Column, key: Column, context: Column) -> Column:
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), context.cast("binary"))


def decrypt(secret: Column, key: Column, context: Column) -> Column:
    """The plain bytes; NULL for a wrong key, wrong context or damaged bytes."""
    return F.try_aes_decrypt(secret, key, F.lit("GCM"), F.lit("DEFAULT"), context.cast("binary"))
