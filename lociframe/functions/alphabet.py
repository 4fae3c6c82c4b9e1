"""Column functions over the alphabet ``$ACGNT``: symbols, codes, complements, run-length bytes.

Symbol codes ascend as the symbols do in binary string order, so sorting strings sorts codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols in code order 0..5, and what each pairs with.
SYMBOLS = "$ACGNT"
PAIRED = ("ACGT", "TGCA")
#: Bits of a symbol in a run-length byte, and of the digit above them.
SYMBOL_BITS, DIGIT_BITS = 3, 5
#: Bits of the length in a packed 16-bit run.
RUN_BITS = 13


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: Column | str) -> Column:
    """Any text over the alphabet: lower-case bases to upper case, every other byte of its UTF-8 form to N."""
    latin = F.decode(F.encode(_col(text), "UTF-8"), "ISO-8859-1")
    return F.translate(F.regexp_replace(latin, "(?s)[^$ACGNTacgnt]", "N"), "acgnt", "ACGNT")


def normalize_fastx(text: Column | str) -> Column:
    """Sequence lines of FASTA and FASTQ: blanks go, case and U/T are unified, the rest is N; never ``$``."""
    tight = F.regexp_replace(_col(text), r"[ \t\r\n\x0b\x0c]", "")
    latin = F.decode(F.encode(tight, "UTF-8"), "ISO-8859-1")
    return F.translate(F.regexp_replace(F.upper(latin), "(?s)[^ACGTU]", "N"), "U", "T")


def code(symbol: Column | str) -> Column:
    """Code of one symbol: 0 to 5; -1 for others."""
    return (F.instr(F.lit(SYMBOLS), _col(symbol)) - 1).cast("int")


def symbol(number: Column | str) -> Column:
    """Symbol of a code; codes outside 0..5 raise an error."""
    n = _col(number)
    return F.when((n < 0) | (n > 5), F.raise_error(F.concat(F.lit("no symbol has code "), n.cast("string")))).otherwise(F.substring(F.lit(SYMBOLS), n.cast("int") + 1, F.lit(1)))


def to_codes(text: Column | str) -> Column:
    """Codes of any text after :func:`normalize`."""
    s = normalize(text)
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(s, ""), code))


def from_codes(codes: Column | str) -> Column:
    return F.array_join(F.transform(_col(codes), symbol), "")


def reverse_complement(s: Column | str) -> Column:
    """Reversed and paired; ``$`` and N pair with themselves."""
    return F.translate(F.reverse(_col(s)), *PAIRED)


def is_kmer(s: Column | str) -> Column:
    return _col(s).rlike(r"^[$ACGNT]*\z")


def checked_kmer(s: Column | str) -> Column:
    """``s``, or an error if it has a character outside the alphabet."""
    return F.when(is_kmer(s) | _col(s).isNull(), _col(s)).otherwise(F.raise_error(F.concat(F.lit("not over $ACGNT: "), _col(s))))


def checked_read(s: Column | str) -> Column:
    """``s``, or an error if it has ``$`` or a character outside the alphabet."""
    return F.when(_col(s).rlike(r"^[ACGNT]*\z") | _col(s).isNull(), _col(s)).otherwise(F.raise_error(F.concat(F.lit("not over ACGNT: "), _col(s))))


def run_bytes(sym: Column | str, length: Column | str) -> Column:
    """A run as an array of bytes (0..255): its length in base 32, least digit first, each above the symbol's code."""
    n = _col(length).cast("long")
    digits = F.floor((F.length(F.bin(n)) - 1) / DIGIT_BITS).cast("int")
    return F.transform(
        F.sequence(F.lit(0), digits),
        lambda d: (code(sym) + ((F.call_function("shiftright", n, d * DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))) * (1 << SYMBOL_BITS)).cast("int")),
    )


def byte_symbol(byte: Column | str) -> Column:
    return symbol(_col(byte).bitwiseAND((1 << SYMBOL_BITS) - 1))


def byte_digit(byte: Column | str) -> Column:
    return F.shiftright(_col(byte), SYMBOL_BITS).cast("long")


def pack_run(sym: Column | str, length: Column | str) -> Column:
    """A run of up to 8191 as 16 bits: code low, length high."""
    n = _col(length)
    return F.when((n < 0) | (n >= 1 << RUN_BITS), F.raise_error(F.lit("run too long to pack"))).otherwise(code(sym) + n.cast("int") * (1 << SYMBOL_BITS))


def unpack_run(packed: Column | str) -> Column:
    """(sym, len) of :func:`pack_run`."""
    p = _col(packed)
    return F.struct(symbol(p.bitwiseAND(7)).alias("sym"), F.shiftright(p, SYMBOL_BITS).cast("long").alias("len"))
