"""Pieces of text that the token encoder sends to the library end to end."""

import public_tokenizers

from tickflow.llm import tokens


def test_pieces_with_a_space_are_encoded_end_to_end():
    """The library's fast encoding numbers no words, so no piece was learned from a joined text and each was encoded again alone."""
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), special=True)
    pieces = [f" {word}{k}" if k % 3 else f" {word}" * 1 + "ß" * k for k, word in enumerate(["athawh", "été", "日本", "...", "'", "Ġ", "Ωmega", "x" * 300] * 40)]
    pieces = [p for p in dict.fromkeys(pieces) if len({c.isalpha() for c in p[1:]}) == 1]
    encoder._remember_joined(pieces)
    assert set(encoder.places) == set(pieces)
    for piece in pieces:
        at = encoder.places[piece]
        want = encoder.tokenizer.encode(piece, add_special_tokens=False).ids
        assert encoder.ids[encoder.starts[at] : encoder.starts[at + 1]].tolist() == want
