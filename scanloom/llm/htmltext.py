"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. A block's features are its words and
link density, those of its neighbours, whether it is a heading or holds a legal
mark, and what its containers say of it, if anything. A decision tree (CART by
Gini impurity) trained on the small labelled table below keeps or drops each
block. Most labelled blocks stand in pages whose containers say nothing, so
words and links of a block and its neighbours decide first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option datalist title".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and roles that hold no main text, and those that do.
APART = frozenset("head nav header footer aside form button dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
MAIN = frozenset("article main".split())
#: Words of class and id that mark containers apart, and those that mark main ones.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo related replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar toc tooltip widget".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+>|<[!?][^>]*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Words of a block that speak of rights.
LEGAL = re.compile(r"©|\(c\) ?[0-9]|\bcopyright\b|\ball rights reserved\b", re.I)
#: words, link density; the same of the block before and after (0 where there is none); a heading; a legal mark; in a container apart; in a main container (1), beside the page's main container (-1) or neither (0)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "legal", "apart", "main")

#: The labelled table: features as listed, then 1 for main text.
LABELLED = (
    # pages whose containers say nothing: text of any length between text, a long block by itself, or all there is
    (60, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (35, 0.1, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (22, 0.2, 30, 0.1, 3, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 35, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0, 1), (4, 0.0, 50, 0.0, 65, 0.0, 1, 0, 0, 0, 1), (18, 0.0, 5, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (28, 0.0, 8, 0.0, 1, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 80, 0.0, 70, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 45, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 33, 0.0, 38, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 90, 0.0, 150, 0.0, 0, 0, 0, 0, 1),
    (60, 0.0, 2, 0.0, 3, 0.67, 0, 0, 0, 0, 1), (70, 0.0, 1, 0.0, 1, 1.0, 0, 0, 0, 0, 1), (45, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 1),
    (55, 0.05, 3, 1.0, 2, 0.0, 0, 0, 0, 0, 1), (100, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 12, 1.0, 150, 0.0, 1, 0, 0, 0, 1),
    (14, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 0, 1), (80, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 2, 1.0, 80, 0.0, 0, 0, 0, 0, 1),
    (150, 0.0, 6, 1.0, 90, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (12, 0.25, 70, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (60, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 0, 0.0, 60, 0.0, 1, 0, 0, 0, 1),
    # there: runs of links, short text among short text or links, short and legal text at the end
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (20, 0.9, 15, 0.8, 12, 0.9, 0, 0, 0, 0, 0),
    (40, 0.7, 4, 1.0, 6, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 0), (8, 0.5, 6, 0.5, 5, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (7, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (1, 0.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (3, 0.67, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (1, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (5, 0.6, 70, 0.0, 65, 0.0, 0, 0, 0, 0, 0),
    (4, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (6, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (7, 0.0, 1, 1.0, 0, 0.0, 0, 1, 0, 0, 0), (30, 0.1, 2, 1.0, 0, 0.0, 0, 1, 0, 0, 0), (6, 0.8, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0),
    (3, 1.0, 30, 0.0, 25, 0.0, 0, 0, 0, 0, 0),
    # blocks of the table ``pages`` without its containers: menus, adverts and footers around articles
    (1, 0.0, 10, 0.0, 1, 0.0, 1, 0, 0, 0, 1), (1, 0.0, 12, 0.0, 1, 0.0, 1, 0, 0, 0, 1), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 10, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 20, 0.0, 54, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 59, 0.0, 59, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 1, 0.0, 7, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 2, 0.0, 6, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 2, 0.0, 10, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 2, 0.0, 22, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 3, 0.0, 6, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 6, 0.0, 12, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 8, 0.0, 3, 0.0, 1, 0, 0, 0, 1),
    (3, 0.0, 9, 0.0, 15, 0.0, 0, 1, 0, 0, 1), (3, 0.0, 26, 0.0, 1, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 1, 0.0, 66, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 8, 0.0, 8, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 46, 0.0, 5, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 1, 0.0, 23, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 59, 0.0, 10, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 2, 0.0, 8, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 6, 0.0, 3, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 6, 0.0, 8, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 8, 0.0, 6, 0.0, 1, 0, 0, 0, 1), (6, 0.0, 54, 0.0, 3, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 58, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 17, 0.0, 5, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (8, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0, 0),
    (8, 0.0, 4, 0.0, 16, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 6, 0.0, 14, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 8, 0.0, 4, 0.0, 0, 0, 0, 0, 1),
    (8, 0.0, 8, 0.0, 59, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 9, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (8, 0.0, 9, 0.0, 8, 0.0, 1, 0, 0, 0, 1), (8, 0.0, 10, 0.0, 8, 0.0, 1, 0, 0, 0, 1),
    (8, 0.0, 43, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (8, 0.0, 149, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 1, 1.0, 20, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 132, 0.0, 8, 0.0, 0, 0, 0, 0, 1),
    (10, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (10, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0, 0, 0),
    (10, 0.0, 5, 0.0, 15, 0.0, 0, 0, 0, 0, 1), (10, 0.0, 10, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (10, 0.0, 23, 0.0, 10, 0.0, 0, 0, 0, 0, 1),
    (11, 0.0, 5, 0.0, 82, 0.0, 1, 0, 0, 0, 1), (11, 0.0, 54, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (12, 0.0, 3, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (13, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0, 0, 0), (14, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (14, 0.0, 8, 0.0, 31, 0.0, 0, 0, 0, 0, 1),
    (15, 0.0, 1, 0.0, 10, 0.0, 0, 0, 0, 0, 1), (15, 0.0, 10, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (15, 0.0, 168, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (16, 0.0, 8, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (18, 0.0, 48, 0.0, 1, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 82, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (23, 0.0, 25, 0.0, 10, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 31, 0.0, 23, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 55, 0.0, 112, 0.0, 0, 0, 0, 0, 1),
    (31, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 0, 1), (31, 0.0, 14, 0.0, 25, 0.0, 0, 0, 0, 0, 1), (54, 0.0, 2, 0.0, 6, 0.0, 0, 0, 0, 0, 1),
    (55, 0.0, 70, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (59, 0.0, 2, 0.0, 5, 0.0, 0, 0, 0, 0, 1), (59, 0.0, 8, 0.0, 2, 0.0, 0, 0, 0, 0, 1),
    (70, 0.0, 10, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (72, 0.0, 1, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (82, 0.0, 11, 0.0, 20, 0.0, 0, 0, 0, 0, 1),
    (112, 0.0, 30, 0.0, 132, 0.0, 0, 0, 0, 0, 1), (132, 0.0, 112, 0.0, 9, 0.0, 0, 0, 0, 0, 1),
    # blocks of that table as they stand
    (3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 26, 0.0, 1, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 160, 0.0, 1, 0.0, 0, 0, 0, 1, 1),
    (4, 0.0, 1, 0.0, 79, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 3, 0.0, 1, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 4, 0.0, 1, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 40, 0.0, 2, 0.0, 0, 0, 0, 1, 1),
    (5, 0.0, 1, 0.0, 11, 0.0, 0, 0, 0, 1, 1), (8, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1, 1), (13, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1, 1),
    (47, 0.0, 1, 0.0, 17, 0.0, 0, 0, 0, 1, 1),
    # in a main container: text with links in it, but not runs of links
    (2, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0, 1, 1), (2, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (10, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 1, 1),
    (50, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1, 1), (1, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 80, 0.0, 1, 0.0, 0, 0, 0, 1, 1),
    (1, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1, 1), (20, 0.3, 40, 0.1, 35, 0.0, 0, 0, 0, 1, 1), (10, 0.6, 50, 0.0, 60, 0.1, 0, 0, 0, 1, 1),
    (4, 1.0, 55, 0.0, 48, 0.0, 0, 0, 0, 1, 1), (9, 0.8, 33, 0.1, 12, 0.2, 0, 0, 0, 1, 1), (250, 0.05, 5, 0.0, 7, 0.0, 0, 0, 0, 1, 1),
    (7, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (15, 0.0, 6, 1.0, 0, 0.0, 0, 0, 0, 1, 1), (6, 1.0, 20, 0.0, 0, 0.0, 1, 0, 0, 1, 1),
    (3, 0.0, 9, 0.9, 8, 1.0, 0, 0, 0, 1, 1), (30, 0.5, 2, 1.0, 40, 0.0, 0, 0, 0, 1, 1), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1, 0),
    (7, 1.0, 6, 1.0, 8, 1.0, 0, 0, 0, 1, 0), (4, 0.95, 5, 1.0, 3, 0.95, 0, 0, 0, 1, 0), (9, 0.0, 45, 0.0, 30, 0.0, 0, 1, 0, 1, 1),
    (60, 0.0, 1, 1.0, 45, 0.0, 0, 0, 0, 1, 1), (6, 0.8, 90, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 1, 1),
    # beside the main container, and long text in containers apart
    (110, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (300, 0.02, 1, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (110, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, -1, 0),
    (15, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, -1, 0), (60, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, -1, 0), (4, 0.0, 70, 0.0, 20, 0.1, 1, 0, 0, -1, 0),
    (30, 0.1, 40, 0.0, 35, 0.0, 0, 0, 0, -1, 0), (3, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, -1, 0), (110, 0.0, 0, 0.0, 90, 0.0, 0, 0, 0, -1, 0),
    (60, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, -1, 0),
    (40, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 0, 0), (150, 0.0, 6, 1.0, 90, 0.0, 0, 0, 1, 0, 0), (70, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1, 0, 0),
    (250, 0.0, 90, 0.0, 60, 0.0, 0, 0, 1, 0, 0), (20, 0.0, 30, 0.0, 40, 0.0, 0, 0, 1, 0, 0), (45, 0.0, 70, 0.0, 50, 0.0, 0, 0, 1, 1, 0),
    (1, 0.0, 200, 0.0, 150, 0.0, 0, 0, 1, 1, 0), (60, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (70, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 0),
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 0), (5, 0.0, 0, 0.0, 90, 0.0, 0, 0, 1, 0, 0),
)


def grown(x: np.ndarray, y: np.ndarray):
    """A decision tree: (feature, bound, tree at or below, tree above), or a class."""
    if (y == y[0]).all():
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        levels = np.unique(x[:, f])
        for bound in (levels[:-1] + levels[1:]) / 2:
            low = x[:, f] <= bound
            impurity = sum(part.sum() * p * (1 - p) for part in (low, ~low) for p in (y[part].mean(),))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound))
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, bound = best
    low = x[:, f] <= bound
    return (f, bound, grown(x[low], y[low]), grown(x[~low], y[~low]))


@lru_cache(maxsize=1)
def default_tree():
    """The tree of the labelled table."""
    rows = np.array(LABELLED, float)
    return grown(rows[:, :-1], rows[:, -1].astype(int))


def classified(tree, row: tuple) -> int:
    """The tree's class of one row of features."""
    while not isinstance(tree, int):
        f, bound, low, high = tree
        tree = low if row[f] <= bound else high
    return tree


def _standing(name: str, attributes: str) -> str:
    """"apart", "main" or "" of an element, by name, role, class and id."""
    if name in ("html", "body"):
        return ""
    role, words = "", []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "apart"
        if key == "role":
            role = value.strip().lower()
        elif key in ("class", "id"):
            for one in value.split():
                parts = [w.lower() for w in NAME_WORD.findall(one)]
                if not {"with", "has", "no", "without"} & set(parts):
                    words += parts
    if name in APART or role in APART_ROLES:
        return "apart"
    if name in MAIN or role in MAIN:
        return "main"
    if name not in INLINE and not APART_WORDS.isdisjoint(words):
        return "apart"
    return "main" if name in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words) else ""


class _Page:
    """The blocks of one page, gathered tag by tag."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, bool, bool, bool]] = []
        self.open: list[tuple[str, str]] = []
        self.apart = self.main = self.links = self.heading = 0
        self.has_main = False
        self.texts: list[str] = []
        self.linked: list[str] = []

    def text(self, piece: str) -> None:
        if piece:
            self.texts.append(piece)
            if self.links:
                self.linked.append(piece)

    def end_block(self) -> None:
        if self.texts:
            words = unescape("".join(self.texts)).split()
            if words:
                linked = len(unescape(" ".join(self.linked)).split()) if self.linked else 0
                self.blocks.append((" ".join(words), len(words), min(linked, len(words)), self.apart > 0, self.main > 0, self.heading > 0))
            self.texts, self.linked = [], []

    def _count(self, element: tuple[str, str], by: int) -> None:
        name, standing = element
        self.apart += by * (standing == "apart")
        self.main += by * (standing == "main")
        self.links += by * (name == "a")
        self.heading += by * (name in HEADINGS)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.texts.append(" ")
        if name in VOID:
            if name == "hr":
                self.end_block()
            return
        if name not in INLINE:
            self.end_block()
        if name in MAIN:  # these never stand in a page's head or menus: a missing end tag
            while any(n in ("head", "nav", "header", "footer") for n, _ in self.open):
                self._count(self.open.pop(), -1)
        if name == "body" and any(n == "head" for n, _ in self.open):
            self.end("head")
        if name == "a" and self.links:
            self.end("a")
        if name in ("p", "li", "td", "th", "tr", "dt", "dd") and any(n == name for n, _ in self.open[-3:]):
            self.end(name)
        standing = _standing(name, attributes)
        self.has_main |= standing == "main" and not self.apart
        self.open.append((name, standing))
        self._count(self.open[-1], 1)

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                while len(self.open) > k:
                    self._count(self.open.pop(), -1)
                return
            if name in INLINE and self.open[k][0] not in INLINE:
                return  # an inline end tag closes nothing outside its block


def blocks_of(html: str) -> tuple[list[tuple[str, int, int, bool, bool, bool]], bool]:
    """(text, words, linked words, apart, main, heading) of each block, and whether the page has a main container."""
    page, at = _Page(), 0
    lower = None
    while (m := TAG.search(html, at)) is not None:
        page.text(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            stop = html.find("-->", at)
            at = len(html) if stop < 0 else stop + 3
            continue
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            page.end(name)
        elif name in RAW:
            if not (m[3] or "").endswith("/"):
                lower = html.lower() if lower is None else lower
                stop = lower.find(f"</{name}", at)
                at = len(html) if stop < 0 else stop
        else:
            page.start(name, m[3] or "")
    page.text(html[at:])
    page.end_block()
    return page.blocks, page.has_main


def block_features(blocks: list[tuple[str, int, int, bool, bool, bool]], has_main: bool) -> list[tuple]:
    """A row of ``FEATURES`` for each block of a page."""
    shares = [(0, 0.0), *((b[1], round(b[2] / b[1], 2)) for b in blocks), (0, 0.0)]
    marks = [(int(b[5]), int(LEGAL.search(b[0]) is not None), int(b[3]), 1 if b[4] else -int(has_main)) for b in blocks]
    return [(*here, *before, *after, *mark) for before, here, after, mark in zip(shares, shares[1:], shares[2:], marks)]


def main_text(html: str | None, tree=None) -> str:
    """The main text: kept blocks in page order, joined by one line feed."""
    tree = default_tree() if tree is None else tree
    blocks, has_main = blocks_of(html or "")
    kept = []
    for b, row in zip(blocks, block_features(blocks, has_main)):
        if classified(tree, row):
            kept.append(b[0])
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars.

    A null html counts as empty; null ids and urls are kept; repeated rows each
    give a row; other columns are not read. Any markup is read to its end:
    what is not closed ends with the page.
    """
    tree = default_tree()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch["html"]]
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
