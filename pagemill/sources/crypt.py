"""The standard security handler: revisions 2 to 4 and 6, by user or owner password; RC4 and the block cipher with keys of 128 and 256 bits."""

from __future__ import annotations

import hashlib
import os

from pagemill.functions import aes
from pagemill.functions.codecs import rc4
from pagemill.sources.pdf import Malformed, Name, Pdf, Ref, Stream

# Fixed value of the format: what passwords are filled up with.
FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class WrongPassword(Malformed):
    """Neither the user's nor the owner's."""


def _md5(*parts: bytes) -> bytes:
    return hashlib.md5(b"".join(parts), usedforsecurity=False).digest()


def _fill(password: bytes) -> bytes:
    return (password + FILL)[:32]


def _turns(key: bytes, data: bytes, numbers) -> bytes:
    for i in numbers:
        data = rc4(bytes(k ^ i for k in key), data)
    return data


def hardened(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """Revision 6's hash: rounds of encrypting and hashing until the last byte allows an end, 64 at least."""
    k, n = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = aes.cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Handler:
    """Opens strings and streams of a document, given its encryption dictionary, first identifier and a password."""

    def __init__(self, said: dict, identifier: bytes, password: str = ""):
        self.revision, version = said.get("R"), said.get("V", 0)
        if said.get("Filter") != "Standard" or self.revision not in (2, 3, 4, 6):
            raise Malformed(f"security handler {said.get('Filter')} revision {self.revision}")
        self.o, self.u = said["O"], said["U"]
        self.flags = (said.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little")
        self.size = 5 if self.revision == 2 else said.get("Length", 40) // 8 if version != 4 else 16
        self.identifier, self.open_metadata = identifier, said.get("EncryptMetadata", True) is False
        self.how = {"StmF": "V2", "StrF": "V2"}
        if version >= 4:
            filters = said.get("CF", {})
            self.how = {k: filters.get(said.get(k, "Identity"), {}).get("CFM", "Identity") for k in self.how}
        self.key = self._hard(said, password.encode()) if self.revision == 6 else self._soft(password.encode("latin-1", "replace"))

    def _file_key(self, password: bytes) -> bytes:
        key = _md5(_fill(password), self.o[:32], self.flags, self.identifier, b"\xff" * 4 if self.revision >= 4 and self.open_metadata else b"")
        for _ in range(50 if self.revision >= 3 else 0):
            key = _md5(key[: self.size])
        return key[: self.size]

    def _user_entry(self, key: bytes) -> bytes:
        return rc4(key, FILL) if self.revision == 2 else _turns(key, _md5(FILL, self.identifier), range(20))

    def _soft(self, password: bytes) -> bytes:
        owner = owner_key(password, self.revision, self.size)
        for p in (password, _turns(owner, self.o[:32], [0] if self.revision == 2 else range(19, -1, -1))):
            key = self._file_key(p)
            n = 32 if self.revision == 2 else 16
            if self._user_entry(key)[:n] == self.u[:n]:
                return key
        raise WrongPassword("the password opens neither as user nor as owner")

    def _hard(self, said: dict, password: bytes) -> bytes:
        password = password[:127]
        for entry, sealed, user in ((self.u, said["UE"], b""), (self.o, said["OE"], self.u[:48])):
            if hardened(password, entry[32:40], user) == entry[:32]:
                return aes.cbc_decrypt(hardened(password, entry[40:48], user), bytes(16), sealed[:32])
        raise WrongPassword("the password opens neither as user nor as owner")

    def _object_key(self, number: int, gen: int, how: str) -> bytes:
        if how == "AESV3":
            return self.key
        more = number.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if how == "AESV2" else b"")
        return _md5(self.key, more)[: min(len(self.key) + 5, 16)]

    def _bytes(self, data: bytes, number: int, gen: int, how: str, seal: bool) -> bytes:
        if how in ("Identity", "None"):
            return data
        key = self._object_key(number, gen, how)
        if how == "V2":
            return rc4(key, data)
        if seal:
            iv = hashlib.sha256(key + data).digest()[:16]
            return iv + aes.cbc_encrypt(key, iv, aes.padded(data))
        return aes.unpadded(aes.cbc_decrypt(key, data[:16], data[16:])) if len(data) >= 32 else b""

    def opened(self, value, number: int, gen: int = 0, seal: bool = False):
        """An object with its strings and its stream decrypted (or, to seal, encrypted)."""
        if isinstance(value, bytes):
            return self._bytes(value, number, gen, self.how["StrF"], seal)
        if isinstance(value, dict):
            return {k: self.opened(v, number, gen, seal) for k, v in value.items()}
        if isinstance(value, list):
            return [self.opened(v, number, gen, seal) for v in value]
        if isinstance(value, Stream):
            if value.dict.get("Type") == "XRef" or value.dict.get("Type") == "Metadata" and self.open_metadata:
                return value
            return Stream(self.opened(value.dict, number, gen, seal), self._bytes(value.raw, number, gen, self.how["StmF"], seal))
        return value


def owner_key(password: bytes, revision: int, size: int) -> bytes:
    key = _md5(_fill(password))
    for _ in range(50 if revision >= 3 else 0):
        key = _md5(key)
    return key[:size]


def handler_of(pdf: Pdf, password: str) -> Handler:
    said = pdf.get(pdf.trailer["Encrypt"])
    said = {k: pdf.get(v) for k, v in said.items()}
    said["CF"] = {k: pdf.get(v) for k, v in (said.get("CF") or {}).items()}
    ids = pdf.get(pdf.trailer.get("ID")) or [b""]
    return Handler(said, pdf.get(ids[0]), password)


def sealed(data: bytes, user: str, owner: str, method: str = "AESV2", identifier: bytes | None = None) -> bytes:
    """The document encrypted: method is V2 (RC4, 128 bits), AESV2 or AESV3, for revisions 3, 4 and 6."""
    from pagemill.sources import writer

    pdf = Pdf.open(data)
    identifier = identifier or hashlib.sha256(data).digest()[:16]
    said: dict = {"Filter": Name("Standard"), "P": -4, "Length": 256 if method == "AESV3" else 128}
    said |= {"V2": {"V": 2, "R": 3}, "AESV2": {"V": 4, "R": 4}, "AESV3": {"V": 5, "R": 6}}[method]
    if method != "V2":
        said |= {"CF": {"StdCF": {"CFM": Name(method), "AuthEvent": Name("DocOpen")}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    if method == "AESV3":
        key, salts = os.urandom(32), [os.urandom(8) for _ in range(4)]
        u, o = user.encode()[:127], owner.encode()[:127]
        said["U"] = hardened(u, salts[0]) + salts[0] + salts[1]
        said["UE"] = aes.cbc_encrypt(hardened(u, salts[1]), bytes(16), key)
        said["O"] = hardened(o, salts[2], said["U"]) + salts[2] + salts[3]
        said["OE"] = aes.cbc_encrypt(hardened(o, salts[3], said["U"]), bytes(16), key)
    else:
        said["O"] = _turns(owner_key(owner.encode("latin-1", "replace"), said["R"], 16), _fill(user.encode("latin-1", "replace")), range(20))
        half = Handler.__new__(Handler)
        half.revision, half.o, half.flags, half.identifier, half.size, half.open_metadata = said["R"], said["O"], (-4 & 0xFFFFFFFF).to_bytes(4, "little"), identifier, 16, False
        said["U"] = half._user_entry(half._file_key(user.encode("latin-1", "replace"))) + bytes(16)
    handler = Handler({k: v for k, v in said.items()}, identifier, user)
    objects = {n: handler.opened(pdf.get(Ref((n, 0))), n, 0, True) for n, e in pdf.index.items() if e.kind != "free"}
    number = max(objects) + 1
    info = pdf.trailer.get("Info")
    return writer.write(objects | {number: said}, pdf.trailer["Root"][0], info[0] if info else None, {"Encrypt": Ref((number, 0)), "ID": [identifier, identifier]})
