"""Plain counterparts that tests compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(TO_LOWER))


class Groups:
    """Union of numbers; a group's name is its smallest member."""

    def __init__(self):
        self.over = {}

    def find(self, x):
        while self.over.get(x, x) != x:
            x = self.over[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.over[max(a, b)] = min(a, b)
