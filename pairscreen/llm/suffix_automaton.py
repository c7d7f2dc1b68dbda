"""A suffix automaton over sequences of words, for matching statistics."""


class SuffixAutomaton:
    """Accepts every run of words of the texts added.  Each state stands for runs
    that occur at the same places; it knows the longest of them, the state of the
    next shorter ones (its link), and the least mark of a text that has them."""

    def __init__(self):
        self.next = [{}]
        self.link = [-1]
        self.length = [0]
        self.mark = [None]

    def _state(self, length, following, link, mark):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.mark.append(mark)
        return len(self.next) - 1

    def _split(self, p, q, word):
        """A state for the runs of ``q`` that are no longer than ``p`` and a word."""
        length = self.length
        copy = self._state(length[p] + 1, dict(self.next[q]), self.link[q], self.mark[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words, mark):
        """Add a text.  Texts come by rising mark, so the first mark of a state is
        its least, and a state that is met again keeps it."""
        last = 0
        for word in words:
            p = last
            q = self.next[p].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                continue
            last = self._state(self.length[p] + 1, {}, 0, mark)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)

    def least_marks(self, words, size):
        """For each window of ``size`` words of a text, the least mark of a text
        added that has the window, or None.  The longest match that ends at each
        word is kept by following links; a window occurs where it reaches ``size``."""
        state = matched = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if i + 1 < size:
                continue
            if matched < size:
                out.append(None)
                continue
            while self.length[self.link[state]] >= size:
                state = self.link[state]
                matched = self.length[state]
            out.append(self.mark[state])
        return out
