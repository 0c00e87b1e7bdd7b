"""Awkward texts that every operator must take."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
EDGE_TEXTS = [
    None,
    "",
    " \n\t\n",
    "one",
    "four words in here",
    "same text for two rows, long enough to be a line",
    "same text for two rows, long enough to be a line",
    "naïve café — 日本語 🎉 \x00\x1c <|endoftext|> ▁",
    "A\r\nB\n\n\nC  D   E",
    LONG,
]
