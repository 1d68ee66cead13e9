def words_of(n, first):
    """So many different invented words."""
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576 % 26)}" for k in range(first, first + n))
