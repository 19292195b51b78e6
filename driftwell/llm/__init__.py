"""llm"""
