"""The byte alphabet of byte-level BPE vocabularies, by its rule."""


def byte_values() -> dict[str, int]:
    """Printable character of a vocabulary string -> byte.

    Bytes that are printable in Latin-1 stand for themselves; the others take
    the code points from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
