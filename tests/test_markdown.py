"""Code lines in Markdown, each expectation written by hand: `!` before a line that is code."""

import pytest

from corpusloom.operators.chunking import chunk_text, code_lines, ChunkConfig

CASES = {
    "fence": [" a", "!```py", "!x", "!", "!y", "!```", " b"],
    "open fence": [" a", "!~~~~", "!x", "!~~~", "!y"],
    "indented": [" a", " ", "!    x", "!", "!    y", " ", " b"],
    "no code within a paragraph": [" a", "     x", " ", "!    y"],
    "quoted fence": [" > a", "!> ```", "!> x", "!>", "!> y", "!> ```", " > b"],
    "a quote's fence ends with the quote": [" > a", "!> ```", "!> x", " b", " c"],
    "a quoted paragraph goes on lazily": [" > a", "     b", " ", "!    c"],
    "fence in an item": [" - a", " ", "!  ```", "!  x", "!", "!  y", "!  ```", " b"],
    "fence in a nested item": [" 1. a", "    - b", " ", "!     ```", "!     x", "!", "!     ```"],
    "a paragraph of an item is no code": [" - a", " ", "     b", " ", "!      c"],
    "code that begins an item": ["!-     x", " ", "   a"],
    "an item's fence ends with the item": [" - a", "!  ```", "!  x", " b"],
    "quote in an item": [" - > a", "!  > ~~~", "!  > x", "   b"],
    "item in a quote": [" > - a", " >", "!>   ```", "!>   x", "!>   ```", " > b"],
    "html": [" <div>", "     x", " </div>", " ", "!    y"],
    "html up to its end": [" <!-- a", " ", "     x", "  -->", "!    y"],
    "html within a line": [" <script>a</script>", "!    x"],
    "a lone tag doesn't interrupt a paragraph": [" a", " <x-y>", "     b"],
    "headings and rules end paragraphs": [" # a", "!    x", " ---", "!    y", " b", " ===", "!    z"],
    "ordered items interrupt only from 1": [" a", " 2. b", "     c", " 1. d", " ", "!       e"],
    "backticks in a fence's info are none": [" ``` a`b", " x"],
    "tabs": [" a", " ", "!\tx", " ", " - b", " ", "!\t\tc"],
    "a rule is no item": [" * * *", "!    x"],
    "an unmarked line ends a quote's code": [" >", "!>     x", "!    y"],
}


@pytest.mark.parametrize("name", CASES)
def test_code(name):
    rows = [c[1:] for c in CASES[name]]
    assert code_lines([r + "\n" for r in rows]) == [c[0] == "!" for c in CASES[name]]


def test_blank_lines_in_an_items_fence_cut_nothing():
    text = "# T\n\nintro\n\n1. a\n   - b\n\n     ```\n     x\n\n     y\n     ```\n\nend\n"
    pieces = chunk_text(text, "text/markdown", "t.md", ChunkConfig())
    assert [p[0] for p in pieces] == ["# T\n\nintro\n", "1. a\n   - b\n", "     ```\n     x\n\n     y\n     ```\n", "end\n"]
    assert all(p[1] == ["T"] for p in pieces)
