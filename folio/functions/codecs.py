"""Encrypted values: the ciphers are Spark's own; only key derivation, which it lacks, is Python."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the key derivation.
ROUNDS = 65_535
_GCM = r"^ENC\[AES256_GCM,data:([^,]*),iv:([^,]*),tag:([^,]*),type:str\]$"


def is_gcm(value: Column) -> Column:
    return F.startswith(value, F.lit("ENC[AES256_GCM,data:")) & F.endswith(value, F.lit(",type:str]"))


def _gcm_key(salt: Column, password: str) -> Column:
    @F.pandas_udf("binary")  # type: ignore[call-overload]
    def run(salts: pd.Series) -> pd.Series:
        known: dict[bytes, bytes] = {}

        def key(s: bytes | None) -> bytes | None:
            if s is None:
                return None
            if s not in known:
                known[s] = hashlib.pbkdf2_hmac("sha256", password.encode(), s, ROUNDS, 32)
            return known[s]

        return salts.map(lambda s: key(bytes(s)) if s is not None else None)

    return run(salt)


def gcm_encrypt(value: Column, password: str, salt: Column, iv: Column) -> Column:
    """ENC[...] with the salt (16 bytes) as additional data; salt and iv (12 bytes) are arguments, so that results repeat."""
    cipher = F.aes_encrypt(value.cast("binary"), _gcm_key(salt, password), F.lit("GCM"), F.lit("DEFAULT"), iv, salt)
    return F.concat(F.lit("ENC[AES256_GCM,data:"), F.base64(F.substring(cipher, 13, 1 << 30)), F.lit(",iv:"), F.base64(iv), F.lit(",tag:"), F.base64(salt), F.lit(",type:str]"))


def gcm_decrypt(value: Column, password: str) -> Column:
    part = lambda i: F.unbase64(F.regexp_extract(value, _GCM, i))
    salt = part(3)
    clear = F.aes_decrypt(F.concat(part(2), part(1)), _gcm_key(salt, password), F.lit("GCM"), F.lit("DEFAULT"), salt)
    return F.when(is_gcm(value), clear.cast("string"))


def _cbc(salt: Column, password: str) -> tuple[Column, Column]:
    digest = F.unhex(F.sha2(F.concat(F.lit(password.encode()), salt), 256))
    return F.substring(digest, 1, 16), F.substring(digest, 17, 16)


def cbc_encrypt(value: Column, password: str, salt: Column) -> Column:
    """{base64 of salt (8 bytes), pad length, cipher text, padding to 16 bytes}; key and iv come from password and salt."""
    key, iv = _cbc(salt, password)
    body = F.substring(F.aes_encrypt(value.cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), iv), 17, 1 << 30)
    pad = 16 - (8 + F.octet_length(body) + 1) % 16
    return F.concat(F.lit("{"), F.base64(F.concat(salt, F.unhex(F.lpad(F.hex(pad), 2, "0")), body, F.unhex(F.repeat(F.lit("00"), pad)))), F.lit("}"))


def cbc_decrypt(value: Column, password: str) -> Column:
    raw = F.unbase64(F.regexp_extract(value, r"\{([^}]*)\}", 1))
    salt = F.substring(raw, 1, 8)
    pad = F.conv(F.hex(F.substring(raw, 9, 1)), 16, 10).cast("int")
    body = F.substring(raw, F.lit(10), F.octet_length(raw) - 9 - pad)
    key, iv = _cbc(salt, password)
    return F.aes_decrypt(F.concat(iv, body), key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def is_cbc(value: Column) -> Column:
    """A {...} of base64 characters, or a reference ${...}."""
    return F.startswith(value, F.lit("${")) | value.rlike(r"(?s)\{[A-Za-z0-9/+=\r\n]*[^\\\s]\}")


def reused(clear: Column, old: Column, decrypted: Column, fresh: Column) -> Column:
    """The old cipher text where it decrypts to the same value, else the fresh one."""
    return F.when(old.isNotNull() & (decrypted == clear), old).otherwise(fresh)
