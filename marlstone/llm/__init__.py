"""Training-data operators; :mod:`marlstone.llm.registry` lists their queries."""
