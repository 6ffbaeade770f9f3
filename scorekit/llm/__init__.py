"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage. Each module is one operator:
``lm_scoring``, ``chat_windows``, ``simhash``, ``decontamination``, ``langid``, ``toxicity``,
``sp_codec``, ``sharding``, ``token_counts``, ``exact_dedup``, ``pivot_clustering``, ``pu_quality``,
``whitening``; ``components``, ``common``, ``hashing`` and ``vectors`` are helpers, ``queries``
registers the operators' queries.
"""
