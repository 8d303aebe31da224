"""Encrypted mappings. Keys are derived on the driver and passed as a column, never as a plan literal."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 600_000


def derive_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    """PBKDF2 with SHA-256, 32 bytes."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def encrypt(text: Column, key: Column) -> Column:
    return F.aes_encrypt(text, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    """Null where the key or the data is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("GCM")).cast("string")


SALT_BYTES = 32


def seal(text: Column, key: Column, salt: Column) -> Column:
    """An encrypted mapping's file: salt, nonce of 12 bytes, ciphertext with its tag."""
    return F.concat(salt, encrypt(text, key))


def salt_of(data: Column) -> Column:
    return F.substring(data, 1, SALT_BYTES)


def unseal(data: Column, key: Column) -> Column:
    """The text of a file made by ``seal``; ``key`` is derived from the password and the file's salt."""
    return decrypt(F.substring(data, SALT_BYTES + 1, 1 << 30), key)


LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def check_endpoint(url: str, allow_remote: bool = False, offline: bool = False) -> None:
    """Raise unless a model's endpoint is local, or remote ones are allowed."""
    from urllib.parse import urlsplit

    if offline and allow_remote:
        raise ValueError("offline and remote endpoints exclude each other")
    host = urlsplit(url if "//" in url else f"//{url}").hostname or ""
    if url and host not in LOCAL_HOSTS and (offline or not allow_remote):
        raise PermissionError(f"{host or url} is not a local endpoint")
