"""Words as the contracts define them."""

import re

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text):
    return _WORD.findall((text or "").encode().translate(_LOWER))
