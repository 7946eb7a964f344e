"""cordwood.streaming"""
