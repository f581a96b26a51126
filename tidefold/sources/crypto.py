"""Sealing and opening of records: AES-256-GCM with the nonce in front, keys by PBKDF2 and HKDF on the driver.

Keys never enter a column of a stored table; they are literals of a plan that is built and run.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS, KEY_CHECK = 210_000, "tidefold:keycheck:v1"


def derive(passphrase: str, vault: str, iterations: int = ITERATIONS, namespace: str = "tidefold", salt_prefix: str = "tidefold:salt:") -> dict[str, bytes]:
    """Keys for encryption, blinding and verification. To read what another deployment sealed, give its namespace and salt prefix."""
    salt = hashlib.sha256((salt_prefix + vault).encode()).digest()
    master = hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, iterations)
    extract = hmac.digest(bytes(32), master, "sha256")
    return {k: hmac.digest(extract, f"{namespace}:{k}:v1".encode() + b"\1", "sha256") for k in ("enc", "blind", "verify")}


def slot(text: str = KEY_CHECK) -> str:
    """The hash under which the key check is stored."""
    return hashlib.sha256(text.encode()).hexdigest()


def seal(data: Column, key: bytes, nonce: Column | None = None) -> Column:
    """nonce, ciphertext and tag; a random nonce unless one is given (12 bytes)."""
    parts = [data.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT")]
    return F.aes_encrypt(*parts, nonce) if nonce is not None else F.aes_encrypt(*parts)


def unseal(data: Column, key: bytes) -> Column:
    """The plain bytes; null where key or data are wrong."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def seal_op(op: Column, key: bytes, nonce: Column | None = None) -> Column:
    return F.base64(seal(F.to_json(op), key, nonce))


def unseal_op(text: Column, key: bytes, ddl: str) -> Column:
    return F.from_json(unseal(F.try_to_binary(text, F.lit("base64")), key).cast("string"), ddl)


def blind(hashes: Column, key: bytes) -> Column:
    """HMAC-SHA256 of each hash, as hex, by built-in functions: two hashes with the key padded in two ways."""
    inner, outer = pads(key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), hashes.cast("binary")), 256))), 256)


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer padded keys of HMAC-SHA256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)


def key_check(sealed: Column, key: bytes, text: str = KEY_CHECK) -> Column:
    """Whether sealed bytes open to the known text; false for anything else."""
    return F.coalesce(unseal(sealed, key).cast("string") == text, F.lit(False))
