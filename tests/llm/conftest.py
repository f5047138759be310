import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, ties, repeats, one very long word, one very long text, marks and special strings."""
    return [None, "", "   ", "\n\t", "a", "a", "The cat, the Cat.", "the cat, the cat.", "x" * 50_000, "word " * 20_000, "É é ü\x1cq\x85z", "<|endoftext|> in a text", "don't stop!! it's 3.14", "Ünïcödé ÅÉ Σίσυφος ὈΔΥΣΣΕΎΣ", "é É", "a\r\nb", "#### $$$ | | !!"]
