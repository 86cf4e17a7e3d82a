"""Operations for preparing large text corpora; nothing else in wavefix imports this."""
