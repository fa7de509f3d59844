"""Names longer than 48 letters and of more than four words, misspelt and in another order."""

import itertools

import pytest

from lectern.llm import canonical

LONG = "Chair of the Interdepartmental Commission for Comparative Manuscript Studies"


def test_misspelt_long_and_reordered_names():
    trie = canonical.Trie([(1, LONG), (2, "Keeper of the Old River Gate"), (3, "Keeper")])
    assert canonical.match(trie, LONG.replace("Manuscript", "Manuscirpt"))[0] == 1
    assert canonical.match(trie, "Comparative Manuscript Studis: Interdepartmental Commission for the Chair of")[0] == 1
    assert canonical.match(trie, "River Gaet Keeper of the Old")[0] == 2
    assert canonical.match(trie, "River Bank Reader of the New") == (0, 1.0)


@pytest.mark.parametrize("words", ["ab cd e fg h", "ba dc e gf h", "h fgx cd ab e", "cd ab xx fg h", "e e ab cd h", "fgh ab c d e f", "a b c d ef"])
def test_orders_equal_permutations(words):
    trie = canonical.Trie([(1, "ab cd e fg h"), (2, "abc de fgh"), (3, "hgf edc ba"), (4, "e ab e cd h"), (5, "bacdefhg")])
    parts = words.split()
    least = {}
    for order in itertools.permutations(parts):
        for d, _, i in trie.within("".join(order)):
            least[i] = min(d, least.get(i, 9))
    got = {}
    for d, _, i in trie.within_orders(parts):
        got[i] = min(d, got.get(i, 9))
    assert got == least
