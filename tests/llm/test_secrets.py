"""Planted secrets beside words, and identifiers that are none."""

import random
import string

import public_tokenizers
import pytest

from opslens.llm import secret_scan

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
KEY = string.ascii_letters + string.digits


def _random(text):
    return [(start, end) for start, kind, end in secret_scan.find_spans(text, PATH, PATTERN) if kind == 3]


@pytest.mark.parametrize("alphabet", [KEY, string.ascii_letters, KEY + "+/"])
@pytest.mark.parametrize("name", ["", "authorization=", "customer_session_identifier=", "AccountKey=", "customer-session-identifier-", "path/to/the/storage/"])
def test_random_values_beside_words(name, alphabet):
    rng = random.Random(11)
    for n in (20, 32):
        keys = ["".join(rng.choices(alphabet, k=n)) for _ in range(200)]
        if "/" in alphabet:  # a slash that joins words can't be told from one of the key's own
            keys = [k for k in keys if "/" not in k] if "/" in name or "-" in name else keys
        missed = [k for k in keys if not any(a <= 4 + len(name) and b >= 4 + len(name) + n for a, b in _random(f"see {name}{k} here"))]
        assert len(missed) <= 0.02 * len(keys)


def test_spans_are_the_values():
    assert _random("the_customer_session_identifier_number=q9Zx8Lk2Vw7Rt4Yp.") == [(39, 55)]


def test_identifiers_are_no_secrets():
    for text in (
        "customer_session_identifier=maintenance_window_schedule", "org/springframework/beans/factory/support/AbstractAutowireCapableBeanFactory", "internationalization", "====================",
        "123e4567-e89b-42d3-a456-426614174000", "MODULE__CURSES_PANEL_LDFLAGS", "_parse_hh_mm_ss_ff", "MAXIMUM_CONNECTION_TIMEOUT=30000", "12345678901234567890", "getApplicationContextConfigurationProperties",
    ):
        assert not _random(text), text
