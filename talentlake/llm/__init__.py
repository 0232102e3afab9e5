"""Operations of a training-data pipeline over document corpora; nothing else in the package imports this one."""
