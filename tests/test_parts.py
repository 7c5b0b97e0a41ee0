"""What files hold beside text: graphics, trees, ciphers, changes; on files made here and on damaged ones."""

import random
import re
import struct
import zlib
from datetime import UTC, datetime

import numpy as np
import pytest

from pagemill.functions import aes, der, fonts, images, signing
from pagemill.plans import casebook
from pagemill.sources import changes, crypt, parts, pdf, walk, writer, xfa

CASE = casebook.case_file(60, ["user", "assistant", "user", "é"])


def painted(content, resources=None):
    return list(walk.walk(pdf.Pdf(b""), content, resources or {}))


def test_blocks_by_the_standard_vectors():
    text = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(size))
        assert aes.cbc_encrypt(key, bytes(16), text).hex() == want and aes.cbc_decrypt(key, bytes(16), bytes.fromhex(want)) == text
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 500):
        data, key, iv = rng.randbytes(n), rng.randbytes(16), rng.randbytes(16)
        assert aes.unpadded(aes.cbc_decrypt(key, iv, aes.cbc_encrypt(key, iv, aes.padded(data)))) == data
    assert aes.cbc_decrypt(bytes(16), bytes(16), b"short") == b"" and aes.unpadded(b"") == b""


@pytest.mark.parametrize("method", ["V2", "AESV2", "AESV3"])
def test_encrypted_documents(method):
    plain = pdf.Pdf.open(CASE)
    shut = crypt.sealed(CASE, "pw é", "owner", method)
    assert b"123-45-6789" not in shut and b"123-45-6789" in CASE
    for password in ("pw é", "owner"):
        opened = pdf.Pdf.open(shut, password=password)
        assert list(parts.READERS["fields"](opened)) == list(parts.READERS["fields"](plain))
        assert [opened.contents(p) for p, _ in opened.pages()] == [plain.contents(p) for p, _ in plain.pages()]
    for password in ("", "no", "owne"):
        with pytest.raises(crypt.WrongPassword):
            pdf.Pdf.open(shut, password=password)
    assert pdf.Pdf.open(CASE, password="any").handler is None


def test_unknown_security_handlers():
    for said in ({"Filter": pdf.Name("Other"), "R": 3}, {"Filter": pdf.Name("Standard"), "R": 5}):
        with pytest.raises(pdf.Malformed):
            crypt.Handler(said, b"")


def test_graphics_state_and_paths():
    out = painted(b"1 J 2 j 3 M [3 1] 0 d 2 w 0.5 g 1 0 0 RG 0 0 m 10 0 l 10 10 l s 0 0 0 1 k /P cs 0.1 /p scn 5 5 m 6 7 8 9 10 11 c h B* W n 1 1 2 2 re f")
    assert [(x.op, x.paint, x.segments) for x in out] == [("s", "s", 3), ("B*", "fs", 2), ("f", "f", 4)]
    assert out[0].state.fill == "DeviceGray 0.5" and out[0].state.stroke == "DeviceRGB 1 0 0" and (out[0].state.cap, out[0].state.join, out[0].state.miter, out[0].state.width) == (1, 2, 3.0, 2.0)
    assert out[0].state.dash.startswith("3 1") and out[1].state.fill == "P 0.1 /p" and out[2].state.clips == 1 and out[2].box == (1, 1, 3, 3)
    assert painted(b"q 2 0 0 3 5 7 cm 0 0 1 1 re f Q 0 0 1 1 re f")[0].box == (5, 7, 7, 10)
    assert [x.kind for x in painted(b"BI /W 1 ID \x01\x02 EI BT /F 2 Tf 1 2 Td (a) Tj T* [(b) 3 (c)] TJ ET (x) ' sh")] == ["inline", "text", "text", "text"]
    assert painted(b"1 l m f (unclosed [ << re f") == []


def test_forms_within_forms():
    objects = {1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref((2, 0))}, 2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref((3, 0))]}, 3: {"Type": pdf.Name("Page"), "Resources": {"XObject": {"A": pdf.Ref((4, 0))}}, "Contents": pdf.Ref((5, 0))},
               4: pdf.Stream({"Subtype": pdf.Name("Form"), "Matrix": [2, 0, 0, 2, 0, 0], "Resources": {"XObject": {"A": pdf.Ref((4, 0))}}}, b"1 1 1 1 re f /A Do"), 5: pdf.Stream({}, b"1 0 0 1 10 0 cm /A Do")}
    out = list(parts.READERS["ops"](pdf.Pdf.open(writer.write(objects, 1))))
    assert len(out) == walk.DEEPEST_FORM and out[0][5:9] == (12.0, 2.0, 14.0, 4.0)


def test_minified_contents_mean_the_same():
    rng = random.Random(3)
    pieces = [b"q", b"Q", b"1", b"-.5", b"(a % b  c)", b"<0a 0B>", b"/N", b"/ ", b"[", b"]", b"<<", b">>", b"re", b"f*", b"% note\n", b"  \n", b"\t", b"(\\)(x))", b"true"]
    for _ in range(300):
        content = b" ".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        less = walk.minified(content)
        assert [t[:2] for t in pdf.tokens(less)] == [t[:2] for t in pdf.tokens(content)] and len(less) <= len(content)
    image = b"q BI /W 2  ID \x00 %  \xff EI  Q % end"
    assert walk.minified(image) == b"q BI /W 2  ID \x00 %  \xff EI\nQ"


def test_arrowheads():
    a, tip, b = walk.arrowhead(0, 0, 10, 0, 2, 30)
    assert tip == (10, 0) and a[0] == pytest.approx(10 - 2 * 0.8660254) and abs(a[1]) == pytest.approx(1) and a[1] == pytest.approx(-b[1])
    assert walk.arrowhead(1, 1, 1, 1, 5) == [(1, 1)]


def test_outlines_round_trip():
    rng = random.Random(4)
    for _ in range(20):
        entries, depth = [], 0
        for i in range(rng.randrange(12)):
            depth = rng.randrange(depth + 3)
            entries.append((f"t{i} ü", rng.randrange(6), depth))
        got = list(parts.READERS["outlines"](pdf.Pdf.open(changes.write_outline(CASE, entries))))
        assert sorted((t, p) for _, _, _, t, p in got) == sorted((t, p if p < 4 else -1) for t, p, _ in entries)
        place = {n: i for i, (n, *_) in enumerate(got)}
        assert all(a is None or place[a] < place[n] for n, a, *_ in got) or not got


def test_loops_end():
    ring = {1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref((2, 0)), "Outlines": {"First": pdf.Ref((4, 0))}, "AcroForm": {"Fields": [pdf.Ref((5, 0))]}, "Names": {"Dests": pdf.Ref((6, 0))}},
            2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref((3, 0)), pdf.Ref((2, 0))]}, 3: {"Type": pdf.Name("Page")},
            4: {"Title": b"a", "Next": pdf.Ref((4, 0)), "First": pdf.Ref((4, 0)), "Dest": b"x"}, 5: {"T": b"f", "Kids": [pdf.Ref((5, 0))]}, 6: {"Kids": [pdf.Ref((6, 0))], "Names": [b"x", b"x"]}}
    p = pdf.Pdf.open(writer.write(ring, 1))
    assert [r[3:] for r in parts.READERS["outlines"](p)] == [("a", -1)] and len(list(parts.READERS["fields"](p))) == 1


def test_sanitize_and_scrub():
    clean = pdf.Pdf.open(changes.sanitize(CASE))
    assert list(parts.READERS["active"](clean)) == [] and len(list(clean.pages())) == 4 and not clean.warnings
    some = pdf.Pdf.open(changes.sanitize(CASE, ["javascript"]))
    assert {c for _, c in parts.READERS["active"](some)} == {"attachment", "metadata", "action"}
    hide = lambda t: re.sub(r"\d{3}-\d{2}-\d{4}", "[gone]", t)
    scrubbed = changes.scrub(CASE, hide)
    assert b"123-45-6789" not in scrubbed and scrubbed.count(b"[gone]") == 2
    signed = [r[4] for r in parts.READERS["signatures"](pdf.Pdf.open(scrubbed))]
    assert signed == [b"%PDF-1.7%PDF-1.7"]


def test_damaged_files_are_errors_of_their_own(spark):
    rng, rows = random.Random(5), [(0, bytearray(CASE)), (1, None), (2, bytearray(b"nothing"))]
    for k in range(12):
        bad = bytearray(CASE)
        for _ in range(40):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows.append((10 + k, bad))
    files = spark.createDataFrame(rows, "doc_id long, content binary")
    for what in parts.READERS:
        assert pdf.relation(files, what).where("doc_id = 0").count() > 0 or what == "outlines"
    out = {r.doc_id: r for r in changes.changed(files, changes.minify).collect()}
    assert len(out) == len(rows) and out[0].error is None and out[1].error and out[2].error
    assert pdf.relation(files, "documents", password="x").where("doc_id = 0").first().encrypted is False


def test_images_round_trip():
    rng = np.random.default_rng(6)
    for channels in (1, 2, 3, 4):
        for size in ((1, 1), (7, 5), (16, 33)):
            frame = images.Frame(rng.integers(0, 256, (*size, channels), dtype=np.uint8))
            assert (images.decode_png(images.encode_png(frame)).samples == frame.samples).all()
            back = images.decode_bmp(images.encode_bmp(frame)).samples
            assert (back == (frame.samples[..., :3] if channels > 2 else np.repeat(frame.samples[..., :1], 3, axis=2))).all()
            assert images.alike(frame, frame) == pytest.approx(1) and (size == (1, 1) or images.alike(frame, images.Frame(255 - frame.samples)) < 0.5 or channels == 2)
    with pytest.raises(images.BadImage):
        images.alike(frame, images.Frame(frame.samples[:3]))


def test_every_row_filter_and_palettes():
    """Rows filtered here by the plain rule of each kind, read back; two bits by palette."""
    rng = random.Random(7)
    rows, step = [[rng.randrange(256) for _ in range(12)] for _ in range(10)], 3
    body = bytearray()
    for y, row in enumerate(rows):
        up, kind = rows[y - 1] if y else [0] * 12, y % 5
        body.append(kind)
        for i, v in enumerate(row):
            a, b, c = (row[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
            paeth = min((abs(a + b - c - z), k, z) for k, z in enumerate((a, b, c)))[2]
            body.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)

    def chunk(kind, part):
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    def png(head, *parts):
        return images.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", *head, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")

    data = png((4, 10, 8, 2), chunk(b"IDAT", zlib.compress(bytes(body))))
    assert images.decode_png(data).samples.reshape(10, -1).tolist() == rows
    data = png((5, 1, 2, 3), chunk(b"PLTE", bytes(range(12))), chunk(b"IDAT", zlib.compress(b"\0\x1b\xc0")))
    assert images.decode_png(data).samples[0, :, 0].tolist() == [0, 3, 6, 9, 9]
    for bad in (b"", data[:40], data.replace(b"IDAT", b"IDAX"), png((1 << 20, 1 << 20, 8, 2), b""), png((4, 10, 8, 2), chunk(b"IDAT", zlib.compress(bytes(body[:20]))))):
        with pytest.raises(images.BadImage):
            images.decode_png(bad)
    with pytest.raises(images.BadImage):
        images.decode_bmp(b"BM" + bytes(60))


def test_der_by_known_encodings():
    assert der.integer(0) == b"\x02\x01\x00" and der.integer(128) == b"\x02\x02\x00\x80" and der.integer(-128) == b"\x02\x01\x80" and der.integer(-129) == b"\x02\x02\xff\x7f"
    assert der.identifier("1.2.840.113549.1.1.11") == bytes.fromhex("06092a864886f70d01010b")
    for n in (0, 1, -1, 127, 128, -128, 255, 256, 2**31, -(2**63), 2**100):
        assert [e[5] for e in der.decode(der.integer(n))] == [str(n)]
    inner = der.identifier("2.999.3") + der.encode(1, b"\xff") + der.encode(5, b"") + der.encode(4, b"ab") + der.encode(0x80, b"z")
    tree = list(der.decode(der.encode(0x30, inner + der.encode(0x31, der.encode(12, b"x" * 200)))))
    assert [(e[0], e[1], e[5]) for e in tree] == [(0, "SEQUENCE", None), (1, "OBJECT IDENTIFIER", "2.999.3"), (1, "BOOLEAN", "true"), (1, "NULL", None), (1, "OCTET STRING", "6162"), (1, "[0]", "7a"), (1, "SET", None), (2, "UTF8String", "x" * 200)]
    for bad in (b"\x30", b"\x30\x05\x02", b"\x02\x81\x01\x00", b"\x02\x80\x00\x00", b"\x1f\x01\x00"):
        with pytest.raises(der.BadEncoding):
            list(der.decode(bad))


def test_scripts_of_forms():
    xml = """<xdp><template><subform name="f"><field name="a"><value><integer>2</integer></value><calculate><script>f.a + b</script></calculate></field>
      <subform name="g"><field name="b"><value><text>3</text></value><event activity="initialize"><script contentType="application/x-javascript">this.rawValue = b.rawValue.length + 4; c.rawValue = "x";</script></event></field><field name="c"/></subform>
      <field name="d"><event activity="initialize"><script>c = 1 d = (</script></event><validate><script>d</script></validate></field></subform></template></xdp>"""
    form = xfa.Form(xfa.parse(xml))
    assert [n.path for n in form.nodes] == ["f", "f.a", "f.g", "f.g.b", "f.g.c", "f.d"]
    form.fire("initialize")
    assert form.text(form.resolve("c")) == "x" and form.text(form.resolve("b")) == "5"
    form.fire("calculate")
    assert form.text(form.resolve("a")) == "7" and [form.nodes[n].path for n in form.invalid()] == ["f.d"]
    assert form.resolve("b", form.resolve("f.g")) == form.resolve("g.b") == form.resolve("f.g.b.rawValue") and form.resolve("none") is None
    xfa.bind(form, "<f><a>9</a><g><c>new</c></g></f>")
    assert (form.text(form.resolve("a")), form.text(form.resolve("c"))) == ("9", "new")
    for bad in ("<template", "<!DOCTYPE x [<!ENTITY e 'e'>]><template/>", "<other/>"):
        with pytest.raises(xfa.Malformed):
            xfa.parse(bad)


def test_font_programs():
    rng = random.Random(9)
    for codes in ([], [65], list(range(32, 127)), [0x41, 0x391, 0xFFFD, 0x1F600, 0x1F601], rng.sample(range(1, 0x3000), 200)):
        glyphs = {c: rng.randrange(1, 300) for c in codes}
        widths = [rng.randrange(2000) for _ in range(300)]
        data = fonts.build(glyphs, widths, 1024, "Ä family")
        face = fonts.read(data)
        assert face.glyphs == glyphs and face.widths == widths and (face.em, face.ascent, face.descent, face.names) == (1024, 800, -200, {1: "Ä family"})
        text = "".join(map(chr, codes)) + "\u0007"
        assert face.width(text) == pytest.approx(sum(widths[glyphs.get(ord(c), 0)] for c in text) * 1000 / 1024)
        for cut in range(0, len(data), 37):
            with pytest.raises(fonts.BadFont):
                fonts.read(data[:cut])


def test_archived_documents():
    before = pdf.Pdf.open(CASE)
    after = pdf.Pdf.open(changes.archived(CASE))
    root = parts.catalog(after)
    assert b"SSN 123-45-6789 of case 60" in after.get(root["Metadata"]).raw and root["OutputIntents"] and "OCProperties" not in root and not after.warnings
    assert [c for _, c in parts.READERS["active"](after)] == ["metadata", "metadata"]
    assert [after.contents(p) for p, _ in after.pages()] == [before.contents(p) for p, _ in before.pages()]
    assert all(r[-1] and r[4] & 34 == 0 for r in parts.READERS["annotations"](after))


def test_straightened_images():
    """The corners of a projective square land on the corners of its image; straight lines between them stay straight."""
    ramp = images.Frame(np.clip(np.add.outer(np.zeros(50), np.arange(60) * 4), 0, 255).astype(np.uint8)[..., None])
    out = images.straightened(ramp, [(10, 5), (50, 10), (45, 40), (5, 45)], 21, 31).samples[..., 0]
    assert (out[0, 0], out[0, -1], out[-1, -1], out[-1, 0]) == (40, 200, 180, 20) and (np.diff(out.astype(int), axis=1) > 0).all()
    assert (images.straightened(ramp, [(0, 0), (59, 0), (59, 49), (0, 49)], 60, 50).samples == ramp.samples).all()
    assert images.straightened(images.Frame(np.full((1, 1, 3), 9, np.uint8)), [(0, 0)] * 4, 2, 2).samples.tolist() == [[[9] * 3] * 2] * 2


def test_signatures():
    c, now = casebook._certified(), datetime(2026, 1, 1, tzinfo=UTC)
    root = [signing.read_certificate(c["root"])]
    own = signing.read_certificate(c["signer"])
    assert (own.name, own.serial, own.authority, own.start.year, own.end.year) == ("Signer", 3, False, 2020, 2040) and root[0].authority
    message = signing.signed_message(b"text", c["key"], c["signer"], (c["middle"],), "sha512")
    assert signing.check(message, b"text", root, now) == signing.Verdict(True, True, "Signer", ["Signer", "Middle", "Root"], "trusted")
    assert not signing.check(message, b"Text", root, now).whole and signing.check(message, b"text", root, datetime(2041, 1, 1, tzinfo=UTC)).trust == "expired"
    for n in range(300):  # signatures that end with zeros, in files whose room does too
        content = b"%d" % n
        assert signing.check(signing.signed_message(content, c["key"], c["signer"], (c["middle"],)) + bytes(n % 3), content, root, now).genuine
    rng, kept = random.Random(3), 0
    for _ in range(200):  # a changed byte is never taken for the signer's
        bad = bytearray(message)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            v = signing.check(bytes(bad), b"text", root, now)
            kept += v.whole and v.genuine and v.trust == "trusted"
        except signing.BadSignature:
            pass
    assert kept <= 20  # bytes that nothing is signed by: versions, parameters, further certificates' wrapping
    forged = signing.certificate("Signer", c["key"], "Middle", signing.test_key(9))
    assert signing.check(signing.signed_message(b"t", c["key"], forged, (c["middle"],)), b"t", root, now).trust == "signature"
    once = changes.signed(CASE, lambda content: signing.signed_message(content, c["key"], c["signer"], (c["middle"],)), "É")
    twice = changes.signed(once, lambda content: signing.signed_message(content, c["key"], c["signer"]), "B")
    got = {r[0]: r for r in parts.READERS["signatures"](pdf.Pdf.open(twice))}
    assert sorted(r[2] for r in got.values() if r[0] != "sig") == ["B", "É"] and [r[6] for r in got.values() if r[2] == "B"] == [True] and [r[6] for r in got.values() if r[2] == "É"] == [False]
    assert all(signing.check(r[5], r[4], root, now).whole for r in got.values() if r[0] != "sig")
