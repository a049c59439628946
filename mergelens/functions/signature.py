"""Keyed hashes of payloads: HMAC-SHA256 in Arrow batches.

The secret goes to the tasks as a broadcast value. Built-in hash functions would need
the padded keys as literals, and a literal shows in plans, the UI and event logs.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PREFIX = "sha256="


def hmac_sha256(payload: Column, secret: str) -> Column:
    """Lower-case hex HMAC of binary (or UTF-8 string) ``payload``; null for null."""
    shared = SparkSession.active().sparkContext.broadcast(secret.encode())

    @F.pandas_udf("string")
    def digest(payloads: pd.Series) -> pd.Series:
        key = hmac.new(shared.value, digestmod=hashlib.sha256)

        def one(body: bytes | None) -> str | None:
            if body is None:
                return None
            own = key.copy()
            own.update(body)
            return own.hexdigest()

        return payloads.map(one)

    return digest(payload.cast("binary"))


def verified(payload: Column, signature: Column, secret: str, require_secret: bool = False) -> Column:
    """Whether ``signature`` (``sha256=`` and hex, letter case aside) fits the payload.

    A blank secret accepts everything, unless ``require_secret``; then it is an error.
    A null signature, or one without the prefix, doesn't fit.
    """
    if not secret.strip():
        if require_secret:
            raise ValueError("a secret is required")
        return F.lit(True)
    hexed = F.lower(F.substr(signature, F.lit(len(PREFIX) + 1)))
    return F.coalesce(F.startswith(signature, F.lit(PREFIX)) & (hexed == hmac_sha256(payload, secret)), F.lit(False))
