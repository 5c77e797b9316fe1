"""Rows for the rules that the tables only play parts in, with answers worked out by hand in test_rules.py."""

FIXTURES = {
    "iso_dates": [
        (0, '2026-11-15'),
        (1, '2026-11-15T18:19:00'),
        (2, '2026-02-30 00:05'),
        (3, '2026-13-01'),
        (4, 'soon'),
        (5, ''),
        (6, None),
        (7, '2026-10-31T09:07:30.5Z'),
        (8, '2026-10-31T24:00'),
        (9, ' 2026-01-02 '),
        (10, '2026-06-07T12:00+09:00'),
    ],
    "tags": [
        (0, 'jpn-Latn'),
        (1, 'ms-Latn'),
        (2, 'eng'),
        (3, 'haw'),
        (4, 'ryu-Latn'),
        (5, 'EN-Latn'),
        (6, 'zho-Hant'),
        (7, 'id-Latn'),
        (8, 'jw'),
        (9, 'de-Latn-AT'),
        (10, 'fra'),
        (11, 'x'),
    ],
    "images": [
        (1, 5, False, 0.0, 144.0, 0.0, 72.0, 300, 150),
        (1, 5, False, 0.0, 72.0, 0.0, 144.0, 400, 200),
        (2, 3, False, 0.0, 60.0, 0.0, 20.0, 10, 10),
        (3, 2, True, 0.0, 400.0, 0.0, 600.0, 100, 100),
        (4, 2, False, 10.0, 82.0, 0.0, 144.0, 149, 299),
        (5, 1, False, 0.0, 100.0, 0.0, 100.0, 0, 50),
        (6, None, False, 0.0, 100.0, 0.0, 100.0, 50, 50),
        (7, 1, False, 0.0, 100.0, 0.0, 100.0, 50, 50),
    ],
    "boxes": [
        (0, 0, 0, 100, 100, 0, 0, 100, 100),
        (1, 0, 0, 100, 79, 0, 0, 100, 100),
        (2, -50, 0, 100, 80, 0, 0, 100, 100),
        (3, 0, 0, 100, 79.96, 0, 0, 100, 100),
        (4, 200, 0, 300, 100, 0, 0, 100, 100),
        (5, 0, 0, 1, 1, 5, 5, 5, 5),
    ],
    "checklist": [
        ('a', 'title', 'pass,fail'),
        ('a', 'alt', 'pass,fail,na'),
        ('b', 'order', 'pass,fail'),
    ],
    "answers": [
        (1, 'a', 'title', 'pass'),
        (1, 'a', 'alt', 'na'),
        (2, 'a', 'title', 'na'),
        (2, 'a', 'alt', 'fail'),
        (3, 'a', 'title', 'fail'),
        (3, 'a', 'alt', 'pass'),
        (3, 'a', 'odd', 'pass'),
        (4, 'b', 'order', 'fail'),
        (5, 'a', 'alt', 'pass'),
    ],
    "scripts": [
        (1, 'こんにちは'),
        (2, '漢字'),
        (3, '한국어'),
        (4, '漢字 and Latin'),
        (5, 'plain'),
        (6, 'かな漢字'),
        (7, '大学 Press'),
    ],
    "styles": [
        ('Body',),
        ('Head',),
        ('Item',),
        ('Foot',),
    ],
    "objects": [
        (1, 'figure', None, True),
        (2, 'figure', None, False),
        (3, 'table', 5, True),
        (4, 'table', None, True),
        (5, 'list', None, True),
        (6, 'text', None, True),
        (7, 'table', 3, True),
    ],
    "maps": [
        (1, 'Body', 'P'),
        (2, 'Gone', 'P'),
        (3, 'Head', 'Figure'),
        (4, 'Head', 'H9'),
        (5, 'Item', None),
    ],
    "retypes": [
        (1, 6, 'H2'),
        (2, 99, 'H2'),
        (3, 6, 'Table'),
        (4, 1, 'Figure'),
    ],
    "alts": [
        (1, 1, 'A map'),
        (2, 2, 'A plan'),
        (3, 6, 'Text'),
        (4, 1, '  '),
        (5, 99, 'x'),
        (6, 2, None),
    ],
    "figure_texts": [
        (1, 3, 'A plate'),
        (2, 4, ''),
        (3, 5, 'Unseen'),
        (4, 9, 'Not listed'),
        (5, None, 'x'),
        (6, 4, None),
    ],
    "figure_pages": [
        (3, True),
        (4, True),
        (5, False),
    ],
    "table_readings": [
        (1, 3, 1, 0, 0, 0, 4, 0, False),
        (2, 99, 1, 0, 0, 0, None, None, False),
        (3, 4, 1, 0, 0, 0, None, None, True),
        (4, 3, 4, 0, 0, 0, None, None, False),
        (5, 4, 1, 1, -1, 0, None, None, False),
        (6, 3, 1, 0, 0, 0, 5, 5, False),
        (7, 4, 0, 0, 1, 0, None, None, False),
        (8, 3, 1, 1, 0, 0, None, None, False),
        (9, 4, 0, 2, 0, 0, 900, 1, False),
        (10, 7, 1, 0, 0, 0, 2, -1, False),
        (11, 4, 1, 0, 0, 3, None, None, False),
    ],
    "merges": [
        (1, 'Body', 'next', 'Head'),
        (2, 'Body', 'up', 'Head'),
        (3, 'Gone', 'prev', None),
        (4, 'Item', 'prev', 'Gone'),
        (5, 'Item', 'prev', None),
    ],
    "lists": [
        (1, 'Item'),
        (2, 'Gone'),
        (3, None),
    ],
    "kept_lists": [
        (1, 5),
        (2, 6),
    ],
    "note_styles": [
        (1, 'Foot'),
        (2, 'End'),
    ],
    "ranges": [
        (1, 'sections', 1, 12),
        (2, 'sections', 0, 3),
        (3, 'toc', 5, 13),
        (4, 'toc', 2, 2),
        (5, 'adopt_orphans', 3, None),
        (6, 'adopt_orphans', 9, 4),
    ],
    "index_pages": [
        (7, 12),
        (8, 13),
        (9, None),
    ],
    "text_rules": [
        (1, 'top', 1, 4),
        (2, 'side', 1, 4),
        (3, None, 1, 4),
        (4, 'any', 4, 40),
        (5, 'bottom', None, 4),
    ],
    "elements": [
        (1, 1),
        (2, 6),
        (3, 99),
    ],
    "moves": [
        (1, 1, 3, 4, 8),
        (1, 2, 0, 2, 5),
        (1, 3, 6, 7, 12),
        (1, 4, 4, 5, 9),
        (1, 5, 6, 6, 3),
        (1, 6, 10, 11, 9),
        (1, 7, 9, 9, 1),
        (1, 8, 12, 12, 9),
        (1, 9, 8, 8, 9),
        (1, 10, 2, 2, 9),
        (2, 5, 3, 3, 7),
        (2, 6, 3, 3, 9),
    ],
    "misread": [
        (1, 3),
        (1, 9),
        (2, 3),
    ],
    "requested": [
        (1, 'a', 'Tenpyō hōji', 'marks', 'marks'),
        (1, 'b', 'ʻaina', 'hawaiian', 'hawaiian'),
        (1, 'c', 'aina', 'latin', 'latin'),
        (1, 'e', '年前', 'cjk', 'cjk:han_only'),
        (1, 'f', 'vita', 'latin', 'latin'),
        (1, 'g', 'old', 'existing', 'latin'),
        (5, 'a', 'pani', 'latin', 'latin'),
        (5, 'b', 'puhi', 'latin', 'latin'),
        (2, 'a', 'mano', 'latin', 'latin'),
        (2, 'b', 'слово', 'script', 'script:cyrillic'),
        (3, 'a', 'kai', 'latin', 'latin'),
        (4, 'a', 'lai', 'latin', 'latin'),
    ],
    "echoed": [
        (1, 'a', 'hōji'),
        (1, 'f', 'dolce vita'),
    ],
    "replies": [
        (1, 'whole', 'stop'),
        (2, 'partial', 'stop'),
        (3, 'unreadable', 'stop'),
        (4, 'whole', 'length'),
        (5, 'whole', 'stop'),
    ],
    "decisions": [
        (1, 1, 'a', 'TENPYŌ  hōji', 'ja-Latn', 'high', 'language'),
        (1, 2, 'b', 'aina', 'haw', 'high', 'language'),
        (1, 3, 'c', None, 'ms-Latn', 'sure', 'language'),
        (1, 4, 'c', 'aina', 'ms-Latn', 'medium', 'language'),
        (1, 5, 'c', 'aina', 'id', 'low', 'unsure'),
        (1, 6, 'z', 'aina', 'id', 'low', 'unsure'),
        (1, 7, 'e', '年前', 'jpn', 'high', 'language'),
        (1, 8, 'f', 'Dolce-Vita', 'it', 'low', 'because'),
        (1, 9, 'f', 'Dolce-Vita', 'it', 'low', 'unsure'),
        (1, 10, 'g', 'old', 'ang', 'high', 'language'),
        (2, 1, 'a', 'mano', None, 'medium', 'indeterminate'),
        (1, 11, None, None, 'en', 'high', 'language'),
        (5, 1, 'a', 'PANI', 'fr', 'low', 'unsure'),
        (5, 2, 'b', 'puhi', None, 'high', 'english'),
    ],
    "books": [
        (1, 'h1', True, None, None, None, '1'),
        (2, 'h1', True, None, None, None, None),
        (3, 'h1', True, None, None, None, None),
        (4, 'h1', True, None, None, None, None),
        (5, 'h1', False, None, None, None, None),
        (6, 'h1', True, 'h0', None, None, '2'),
        (7, 'h1', True, 'h1', None, '4', None),
        (8, 'h1', True, 'h0', '5', '6', None),
        (9, 'h1', True, 'h0', None, None, None),
    ],
    "results": [
        (1, 'pac', 1, 'h1', '1', True, 0),
        (1, 'screen_reader', 1, 'h1', '1', True, 2),
        (2, 'pac', 1, 'h0', '3', True, 1),
        (3, 'pac', 1, 'h1', None, False, 1),
        (3, 'screen_reader', 1, 'h0', 'x', True, 0),
        (5, 'pac', 1, 'h1', '1', True, 1),
        (5, 'pac', 2, 'h1', '1', True, 0),
        (5, 'screen_reader', 1, 'h1', '1', True, 0),
        (6, 'pac', 1, 'h0', '1', True, 1),
        (6, 'screen_reader', 1, 'h0', '1', True, 0),
        (7, 'pac', 1, 'h1', '1', True, 0),
        (7, 'screen_reader', 1, 'h1', '1', True, 1),
    ],
    "sent": [
        (1, 's1', None, False, False, 'stop', False),
        (2, 's2', None, False, False, 'length', False),
        (20, 'r2', 's2', False, False, 'stop', False),
        (3, 's3', None, False, True, 'stop', False),
        (30, 'r3', 's3', False, False, 'length', False),
        (4, 's4', None, True, False, 'stop', False),
        (5, 's5', None, False, False, 'stop', True),
        (6, 's6', None, False, False, None, False),
        (8, 's8', None, False, True, 'stop', False),
        (80, 'r8', 's8', False, False, 'stop', False),
    ],
    "asked": [
        (1,),
        (2,),
        (3,),
        (4,),
        (5,),
        (6,),
        (7,),
        (8,),
    ],
    "figures": [
        (1, 2.0, 1.5, 2.5, 80, False, 0, None, None, None, None, None, False),
        (2, 2.0, 1.5, 2.5, 80, False, 3, 0.5, 0.25, 1.0, 40, None, True),
        (3, 2.0, None, None, 30, True, 3, 0.5, None, None, 40, None, False),
        (4, 2.0, 1.5, 2.5, 80, False, 3, None, None, None, None, 'too_few', False),
        (5, None, None, None, None, False, 3, 0.5, 0.5, 0.5, 40, None, False),
        (6, 2.0, 1.5, 2.5, 80, False, 3, None, None, None, None, None, False),
    ],
}
