"""Operators of a training-data pipeline over tables of texts, vectors and web pages.

``store``         tables written between steps, in the folder all executors share
``hashing``       word and shingle fingerprints of whole texts, vectorised
``top_k``         1: exact top-k inner products
``dedup``         2: persistent digest index (DataFrame functions only)
``bpe``           3: BPE encoding and decoding over a trie of words
``lm``            4: log-frequency Bloom filter language model
``packing``       5: dominance reduction and best fit
``token_files``   6: patched frame-of-reference token files
``quality``       7: byte-level convolutional classifier
``language``      8: cross-parsing entropy over suffix automata
``jaccard``       9: n-gram Jaccard join
``wrappers``     10: wrapper induction for main text
``variants``      11: spelling variants by Gram matrices of letter counts
``turns``         12: turns aligned with the grammar of conversations
``mixing``       13: capped water-filling
``queries``       the registered queries and their check SQL

Nothing outside this package imports it, but for the guarded registration.
"""
