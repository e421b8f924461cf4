"""Training-data operators: fingerprints, language id, sub-words, captures, licences, quality, de-duplication, decontamination, token files.

Nothing outside this folder imports it.  Every operator module keeps a general interface; ``queries`` derives the
digest columns of the registered queries from them.
"""
