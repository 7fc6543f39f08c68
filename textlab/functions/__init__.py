"""textlab.functions"""
