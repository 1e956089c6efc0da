"""Two invented regulations and a note, as pages."""

ONE = """Official Journal of the European Union
EN
5.5.2017
REGULATION (EU) 2017/745 OF THE EUROPEAN PARLIAMENT
CHAPTER I
Article 1
Subject matter
1. This instrument lays down rules for placing gadgets on the market.
Article 2
Definitions
(1) 'gadget' means any tool, machine or software that its maker intends for use on people;
(2) 'accessory' means an item that is used together with one or more gadgets;
(3) 'maker' means a person who builds a gadget and sells it under their own name;
CHAPTER II
Article 10
General obligations of makers
1. Makers shall make sure that their gadgets have been designed and built as this instrument requires.
2.
Makers shall keep the technical files for ten years after the last gadget has been placed on the market.
3. The technical files shall hold:
(a) a description of the gadget;
(b) the drawings;
(c) the results of tests;
(d) the labels in use.
42
Article 13
Duties of importers
1. Importers shall only place on the market gadgets that meet this instrument and bear the mark.
ANNEX II
Technical documentation lists everything that the maker has to draw up for a gadget.
"""
TWO = """REGULATION (EU) 2017/746 OF THE EUROPEAN PARLIAMENT
CHAPTER I
Article 1
Subject matter
1. This instrument lays down rules for reagents and kits that are used in laboratories.
Article 2
Definitions
(1) 'gadget' means 'gadget' as defined in point (1) of Article 2 of Regulation (EU) 2017/745;
(2) 'kit' means a set of parts that are packed together and used for one test;
CHAPTER II
Article 10
General obligations of makers
1. Makers of kits shall make sure that their kits have been designed and built as this instrument requires.
2. The files shall hold:
(a) a description of the kit;
(b) the drawings;
(c) the results of tests.
Article 13
Duties of importers
1. Importers of kits shall only place on the market kits that bear the mark.
"""
NOTE = "Remember to water the plants on Monday and to feed the cat every day."
